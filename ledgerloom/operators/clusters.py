"""Who funds whom: first funders, clusters, ancestry, deposit addresses, consolidation, contributors, mixer pools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import address_number, create2_address, created_address, created_keys
from ..plans.session import cut, spread
from .ordered import carried_back, running_max_before, running_sum
from .store import RAW

PAYMENT = "sender is not null and recipient is not null and sender <> recipient"


def first_funders(ledger: DataFrame) -> DataFrame:
    """Per address the sender of its first payment by (block, log_index); self-payments don't fund."""
    first = F.min(F.struct("block", "log_index", "tx_hash", "sender", "amount_raw"))  # the order and what it carries, each once
    got = ledger.where(PAYMENT).groupBy(F.col("recipient").alias("address")).agg(first.alias("f"))
    return got.select("address", F.col("f.sender").alias("funder"), F.col("f.tx_hash").alias("tx_hash"), F.col("f.block").alias("block"), F.col("f.amount_raw").alias("amount_raw"))


def first_funders_by_time(ledger: DataFrame) -> DataFrame:
    return ledger.where(f"{PAYMENT} and ts is not null").groupBy(F.col("recipient").alias("address")).agg(F.min_by("sender", F.struct("ts", "block", "tx_hash")).alias("funder"))


def funder_clusters(funders: DataFrame, service_degree: int = 50, exclude: DataFrame | None = None) -> DataFrame:
    """Addresses by common funder; a funder of too many is a service and says nothing about common control."""
    got = funders.groupBy("funder").agg(F.count_distinct("address").alias("size"), F.sum("amount_raw").cast(RAW).alias("funded_raw"), F.min("address").alias("first_address"))
    service = F.col("size") > service_degree
    if exclude is not None:
        got = got.join(exclude.select(F.col("address").alias("funder"), F.lit(True).alias("_x")), "funder", "left")
        service = service | F.coalesce(F.col("_x"), F.lit(False))
    return got.withColumn("service", service).select("funder", "size", "funded_raw", "first_address", "service")


def ancestry(funders: DataFrame, services: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(address, ancestor, generation): first funders upwards, ending at services, cycles or the depth."""
    up = funders.select(F.col("address").alias("child"), F.col("funder").alias("parent"))
    if services is not None:
        stop = services.select(F.col("address").alias("child")).distinct()
        inner = up.join(stop, "child", "left_anti")
    else:
        inner = up
    level = up.select(F.col("child").alias("address"), F.col("parent").alias("ancestor"), F.lit(1).alias("generation"), F.array("child", "parent").alias("line"))
    out = level
    for g in range(2, depth + 1):
        level = level.join(inner, F.col("ancestor") == F.col("child")).where(~F.array_contains("line", F.col("parent"))).select("address", F.col("parent").alias("ancestor"), F.lit(g).alias("generation"), F.array_append("line", F.col("parent")).alias("line"))
        out = out.unionByName(level)
    return out.drop("line")


def batch_funded(funders: DataFrame, blocks: int = 25, ratio: float = 0.9, service_degree: int | None = 50) -> DataFrame:
    """Pairs with the same first funder, within a few blocks, with nearly the same amount. Blocks are bucketed by the
    window, so pairs are sought in neighbouring buckets only, the later one in its own and the one before; services' addresses
    are left out first."""
    few = funders.where("amount_raw > 0")
    if service_degree is not None:
        few = few.join(funder_clusters(funders, service_degree).where("not service").select("funder"), "funder", "left_semi")
    a = few.withColumn("k", F.floor(F.col("block") / blocks))
    b = few.withColumn("k", F.explode(F.array(F.floor(F.col("block") / blocks) - 1, F.floor(F.col("block") / blocks))))
    later = (F.col("a.address") != F.col("b.address")) & (F.struct("a.block", "a.address") < F.struct("b.block", "b.address"))
    got = a.alias("a").join(b.alias("b"), (F.col("a.funder") == F.col("b.funder")) & (F.col("a.k") == F.col("b.k")) & later)
    low, high = F.least("a.amount_raw", "b.amount_raw"), F.greatest("a.amount_raw", "b.amount_raw")
    near = (F.abs(F.col("a.block") - F.col("b.block")) <= blocks) & (low.cast("double") >= high.cast("double") * ratio)
    return got.where(near).select(F.col("a.funder").alias("funder"), F.least("a.address", "b.address").alias("a"), F.greatest("a.address", "b.address").alias("b"))


def deposit_addresses(ledger: DataFrame, services: DataFrame, max_senders: int = 5) -> DataFrame:
    """Addresses with few senders that pay services and nobody else."""
    rows = ledger.where(PAYMENT)
    senders = rows.groupBy(F.col("recipient").alias("address")).agg(F.count_distinct("sender").alias("senders")).where(F.col("senders").between(1, max_senders))
    onward = rows.join(services.select(F.col("address").alias("recipient"), F.lit(1).alias("_s")), "recipient", "left").groupBy(F.col("sender").alias("address")).agg(F.count_distinct("recipient").alias("services"), F.count_if(F.col("_s").isNull()).alias("others")).where("others = 0")
    return senders.join(onward, "address").select("address", "senders", "services")


def consolidation(ledger: DataFrame, seed: str, min_fan_in: int = 3) -> DataFrame:
    """Where what the seed paid out meets again: addresses that at least so many of its payees paid on to."""
    rows = ledger.where(PAYMENT)
    paid = rows.where(F.col("sender") == seed).groupBy(F.col("recipient").alias("member")).agg(F.sum("amount_raw").cast(RAW).alias("from_seed"))
    on = rows.select(F.col("sender").alias("member"), F.col("recipient").alias("hub")).distinct().where(F.col("hub") != seed)
    return paid.join(on, "member").groupBy("hub").agg(F.count("*").alias("fan_in"), F.sum("from_seed").cast(RAW).alias("total_raw")).where(F.col("fan_in") >= min_fan_in)


def contributors(ledger: DataFrame, target: str, subject: str, max_hops: int = 4) -> DataFrame:
    """Who paid into a target, how much, and how each is tied to a subject: itself, reachable from it by payments in
    time order, funded by the same first funder, or not at all. Sums mix assets; `assets` says how many."""
    own = ledger.where(PAYMENT)
    into = own.where(F.col("recipient") == target).groupBy(F.col("sender").alias("address")).agg(F.sum("amount_raw").cast(RAW).alias("total_raw"), F.count("*").alias("n"), F.count_distinct(F.coalesce("asset", F.lit(""))).alias("assets"))
    reach = own.where((F.col("sender") == subject) & F.col("ts").isNotNull()).groupBy(F.col("recipient").alias("address")).agg(F.min("ts").alias("at"))
    steps = own.where("ts is not null").select(F.col("sender").alias("address"), F.col("recipient").alias("next"), "ts")
    for _ in range(max_hops - 1):
        more = reach.join(steps, "address").where("ts >= at").groupBy(F.col("next").alias("address")).agg(F.min("ts").alias("at"))
        reach = reach.unionByName(more).groupBy("address").agg(F.min("at").alias("at"))
    funders = first_funders_by_time(ledger)
    same = funders.where(F.col("address") == subject).select("funder")
    tied = funders.join(same, "funder", "left_semi").select("address").withColumn("_f", F.lit(True))
    got = into.join(reach.select("address", F.lit(True).alias("_r")), "address", "left").join(tied, "address", "left")
    link = F.when(F.col("address") == subject, "self").when(F.col("_r"), "reachable").when(F.col("_f"), "co_funded").otherwise("unlinked")
    return got.select("address", "total_raw", "n", "assets", link.alias("link"))


def deployments(deployers: DataFrame, contracts: DataFrame, search: int = 256) -> DataFrame:
    """(deployer, nonce, contract): which of the contracts (address) each deployer (address) created, by its first
    nonces. They meet by eight bytes of the address; what meets is compared whole."""
    tried = spread(deployers.select(F.col("address").alias("deployer")).distinct(), "deployer").select("deployer", F.posexplode(created_keys(F.col("deployer"), search)).alias("nonce", "key"))
    wanted = cut(contracts.select(F.lower("address").alias("contract")).distinct(), "contracts")  # else the join's filter on keys makes addresses twice
    wanted = wanted.withColumn("key", address_number(F.col("contract")))
    near = cut(tried.join(wanted.hint("merge"), "key").drop("key"), "near")  # stored, so that whole addresses are made of these only
    return near.where(created_address(F.col("deployer"), F.col("nonce")) == F.col("contract"))


def salted_deployments(factories: DataFrame, salts: DataFrame, contracts: DataFrame) -> DataFrame:
    """(deployer, salt, contract): which of the contracts each factory (address) created with one of its salts (address,
    salt, code_hash): a salt is chosen, so only known ones can be tried."""
    tried = salts.join(factories.select("address").distinct(), "address").select(F.col("address").alias("deployer"), "salt", create2_address(F.col("address"), F.col("salt"), F.col("code_hash")).alias("contract"))
    return tried.join(contracts.select(F.lower("address").alias("contract")).distinct(), "contract").select("deployer", "salt", "contract")


def chain_presence(ledger: DataFrame) -> DataFrame:
    """(address, chains, first_block): on how many chains each address occurs, and which."""
    ends = ledger.select("chain", F.col("sender").alias("address")).union(ledger.select("chain", "recipient")).where("address is not null").distinct()
    return ends.groupBy("address").agg(F.count("*").alias("n_chains"), F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"))


# --- mixer pools


def _counted(deposits: DataFrame, withdrawals: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(deposits with `before`: withdrawals of their pool up to them, and `anonymity_set`: those in the window behind
    them; withdrawals with their `place` in the pool's order). Running counts over both in one order: no deposit meets
    a withdrawal in a join."""
    d = deposits.select("pool", "tx", "block", "idx", F.lit(0).alias("w"), F.col("block").alias("p"), F.lit(0).alias("late"), F.lit(1).alias("own"))
    ends = deposits.select("pool", "tx", "block", "idx", F.lit(0).alias("w"), (F.col("block") + window).alias("p"), F.lit(1).alias("late"), F.lit(0).alias("own"))
    w = withdrawals.select("pool", "tx", "block", "idx", F.lit(1).alias("w"), F.col("block").alias("p"), F.lit(0).alias("late"), F.lit(0).alias("own"))
    rows = running_sum(d.unionByName(ends).unionByName(w), ["pool"], ["p", "late", "idx", "own", "tx"], F.col("w"), "c")
    rows = cut(rows)
    sets = rows.where("w = 0").groupBy("pool", "tx", "block", "idx").agg(F.max(F.when(F.col("own") == 1, F.col("c"))).alias("before"), F.max(F.when(F.col("late") == 1, F.col("c"))).alias("until"))
    return sets.select("pool", "tx", "block", "idx", "before", (F.col("until") - F.col("before")).alias("anonymity_set")), rows.where("w = 1").select("pool", F.col("c").alias("place"), F.col("tx").alias("withdrawal"), F.col("block").alias("out_block"))


def anonymity_sets(deposits: DataFrame, withdrawals: DataFrame, window: int = 100) -> DataFrame:
    """Per deposit how many withdrawals of its pool follow within the window."""
    return _counted(deposits, withdrawals, window)[0].select("pool", "tx", "anonymity_set")


def match_withdrawals(deposits: DataFrame, withdrawals: DataFrame, window: int = 100, max_set: int = 5) -> DataFrame:
    """Each deposit with the earliest unclaimed later withdrawal of its pool, in deposit order; deposits with too many
    candidates are refused. Refused ones go first, so each of the others has max_set candidates at most, found by their
    places in the pool's order. Claims depend on each other only along deposits whose candidates overlap: such a chain
    is one group, and chains run apart."""
    schema = "pool long, deposit string, withdrawal string, gap long, anonymity_set int, confidence string"
    sets, places = _counted(deposits, withdrawals, window)
    kept = sets.where(F.col("anonymity_set").between(1, max_set)).withColumn("last", F.col("before") + F.col("anonymity_set"))
    kept = running_max_before(kept, ["pool"], ["block", "idx", "tx"], F.col("last"), "reached")
    starts = F.when(F.col("before") >= F.coalesce("reached", F.lit(0)), 1).otherwise(0)
    kept = running_sum(kept, ["pool"], ["block", "idx", "tx"], starts, "chain")
    pairs = kept.withColumn("place", F.explode(F.sequence(F.col("before") + 1, F.col("last")))).join(places, ["pool", "place"])

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "idx", "tx", "place"])
        taken, done, rows = set(), None, []
        for r in pdf.itertuples():
            if r.tx == done or r.place in taken:
                continue
            taken.add(r.place)
            done = r.tx
            sure = "medium" if r.anonymity_set <= 1 else "low" if r.anonymity_set <= 3 else "speculative"
            rows.append((r.pool, r.tx, r.withdrawal, r.out_block - r.block, r.anonymity_set, sure))
        return pd.DataFrame(rows, columns=["pool", "deposit", "withdrawal", "gap", "anonymity_set", "confidence"])

    return pairs.groupBy("pool", "chain").applyInPandas(claim, schema)


def address_reuse(deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Deposits whose own address withdraws later: the earliest such withdrawal, found by carrying the next
    withdrawal of the address backwards."""
    both = deposits.withColumn("w", F.lit(0)).unionByName(withdrawals.withColumn("w", F.lit(1)))
    both = carried_back(both, ["address"], ["block", "idx", "w", "tx"], F.when(F.col("w") == 1, F.struct("block", "idx", "tx")), "n")
    return both.where("w = 0 and n is not null and (n.block > block or n.idx > idx)").select("address", F.col("tx").alias("deposit"), F.col("n.tx").alias("withdrawal"))


def linked_by_transfer(deposits: DataFrame, withdrawals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Depositors and recipients with a direct payment either way, and the first such payment."""
    d, w = deposits.select(F.col("address").alias("depositor")).distinct(), withdrawals.select(F.col("address").alias("receiver")).distinct()
    rows = ledger.where(PAYMENT).select("sender", "recipient", "block", "tx_hash")
    one = rows.join(d, F.col("sender") == F.col("depositor")).join(w, F.col("recipient") == F.col("receiver"))
    two = rows.join(d, F.col("recipient") == F.col("depositor")).join(w, F.col("sender") == F.col("receiver"))
    return one.unionByName(two).groupBy("depositor", "receiver").agg(F.min_by("tx_hash", F.struct("block", "tx_hash")).alias("tx_hash"), F.count_distinct("tx_hash").alias("n"))
