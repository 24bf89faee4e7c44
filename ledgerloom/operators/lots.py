"""Lots of money as intervals: first in, first out without a queue.

What an address takes in of an asset, laid end to end in order, is an axis; what it pays out, laid end to end, covers the
same axis from its start. So a payment is funded by the receipts whose intervals it overlaps. Where an address pays more
than it is known to hold, the lacking part lies on the axis too, at the end of the payment that lacked it. All of this is
running sums and one overlay of intervals, so a hub's rows spread over many tasks, and the overlay has one row for each
boundary. Its rows link a payment to the earlier ones that fund it. They are resolved in epochs of payments: an epoch of an
asset is a task, all are resolved at once, what crosses epochs is carried on, and rounds stop when nothing changes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, release
from .store import RAW

KEYS = ["chain", "asset"]
ADDRESS = [*KEYS, "address"]
#: Payments of an asset that one task resolves at once, about.
EPOCH = 200_000
#: Ids in a bucket of running sums.
BUCKET = 4096


def _raw(value: Column) -> Column:
    return value.cast(RAW)


def transfers(ledger: DataFrame, epoch: int = EPOCH) -> DataFrame:
    """The ledger's payments, stored, with an `id` that rises with block, index and transaction, and their `epoch`."""
    rows = ledger.where("sender is not null and recipient is not null and amount_raw > 0")
    rows = rows.select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "sender", "recipient", _raw(F.col("amount_raw")).alias("amount"), F.coalesce("block", F.lit(0)).cast("long").alias("block"), F.coalesce("log_index", F.lit(0)).cast("long").alias("log_index"), "tx_hash")
    rows = rows.orderBy("block", "log_index", "tx_hash", "sender", "recipient", "amount").withColumn("id", F.monotonically_increasing_id())
    rows = cut(rows.drop("block", "log_index"), "payments")
    if (rows.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0) <= epoch:
        return rows.withColumn("epoch", F.lit(0).cast("long"))  # one epoch holds all of any asset
    step = max(1, min(4096, epoch // 4))
    some = rows.groupBy(*KEYS, F.floor(F.col("id") / step).alias("_at")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = some.select(*KEYS, "_at", F.floor(before / epoch).alias("epoch"))
    return cut(rows.withColumn("_at", F.floor(F.col("id") / step)).join(epochs, [*KEYS, "_at"]).drop("_at"), "payments-in-epochs")


def funded_by(ledger: DataFrame) -> DataFrame:
    """(chain, asset, payment, receipt, amount_raw): which received payments fund which, first in, first out."""
    paid = transfers(ledger)
    name = lambda end, as_: paid.select(*KEYS, F.col("id").alias(end), F.col("tx_hash").alias(as_))
    got = funding(axes(paid)).join(name("child", "payment"), [*KEYS, "child"]).join(name("parent", "receipt"), [*KEYS, "parent"])
    return got.groupBy(*KEYS, "payment", "receipt").agg(_raw(F.sum(F.col("hi") - F.col("lo"))).alias("amount_raw"))


def start_lots(seeds: DataFrame | None, opening: DataFrame | None) -> DataFrame | None:
    """(chain, asset, address, id, amount, dirty): what addresses hold before the first payment: an opening balance, which is
    clean, and behind it a seed's lot, which isn't. Their ids are negative."""
    out = None
    for given, place, dirty in ((opening, 2, False), (seeds, 1, True)):
        if given is not None:
            own = given.where("amount > 0").select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "address", (-2 * F.pmod(F.xxhash64("address"), F.lit(1 << 61)) - place).alias("id"), _raw(F.col("amount")).alias("amount"), F.lit(dirty).alias("dirty"))
            out = own if out is None else out.unionByName(own)
    return out


def axes(paid: DataFrame, start: DataFrame | None = None, endless: DataFrame | None = None) -> DataFrame:
    """(chain, asset, address, id, incoming, epoch, lo, hi, lacking): the intervals of receipts and payments on each
    address's axis, and what the address lacked so far; stored. start: lots from before the first payment; endless: (chain,
    asset, address) that pay without spending what they hold."""

    def side(end: str, incoming: int) -> DataFrame:
        return paid.select(*KEYS, F.col(end).alias("address"), "id", F.lit(incoming).alias("incoming"), "epoch", "amount")

    out = side("sender", 0)
    events = (out if endless is None else out.join(endless, ADDRESS, "left_anti")).unionByName(side("recipient", 1))
    if start is not None:
        events = events.unionByName(start.select(*ADDRESS, "id", F.lit(1).alias("incoming"), F.lit(-1).cast("long").alias("epoch"), "amount"))
    # sums, and the least balance, inside buckets of ids, then what earlier buckets carry on: one pass for all three
    zero, run = F.lit(0).cast(RAW), (Window.unboundedPreceding, 0)
    part = lambda incoming: F.when(F.col("incoming") == incoming, F.col("amount")).otherwise(zero)
    inside = Window.partitionBy(*ADDRESS, "_k").orderBy("id", "incoming").rowsBetween(*run)
    own = events.withColumn("_k", F.floor(F.col("id") / BUCKET)).withColumns({"_in": F.sum(part(1)).over(inside), "_out": F.sum(part(0)).over(inside)})
    own = cut(own.withColumn("_low", F.min(F.col("_in") - F.col("_out")).over(inside)), "axes-buckets")
    before = Window.partitionBy(*ADDRESS).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(*ADDRESS, "_k").agg(F.max("_in").alias("i"), F.max("_out").alias("o"), F.min("_low").alias("low"))
    blocks = blocks.withColumns({c: F.coalesce(F.sum(c[1:]).over(before), zero) for c in ("_i", "_o")})
    blocks = blocks.withColumn("_l", F.min(F.col("_i") - F.col("_o") + F.col("low")).over(before)).select(*ADDRESS, "_k", "_i", "_o", "_l")
    got = own.join(blocks, [*ADDRESS, "_k"])
    least = F.least("_l", F.col("_i") - F.col("_o") + F.col("_low"))
    lacking = _raw(F.greatest(zero, -least))  # as far as the balance would have fallen below nothing
    lo = F.when(F.col("incoming") == 1, F.col("_i") + F.col("_in") - F.col("amount") + lacking).otherwise(F.col("_o") + F.col("_out") - F.col("amount"))
    out = cut(got.select(*ADDRESS, "id", "incoming", "epoch", _raw(lo).alias("lo"), _raw(lo + F.col("amount")).alias("hi"), lacking.alias("lacking")), "axes")
    release(own)
    return out


def funding(axis: DataFrame) -> DataFrame:
    """(chain, asset, child, child_epoch, parent, parent_epoch, at, lo, hi): the part [lo, hi) of a receipt that funds a
    payment from `at` on. One row for each overlap; what a payment lacked has no row.

    Axes are cut into cells, about as many as an address has rows, so that intervals needn't be compared with each other:
    inside a cell the latest receipt and payment are carried along the order of starts."""
    scale = axis.groupBy(*ADDRESS).agg(F.max("hi").alias("_most"), F.count("*").alias("_n"))
    rows = axis.join(scale.select(*ADDRESS, _raw(F.floor(F.col("_most") / F.col("_n")) + 1).alias("cell")), ADDRESS)
    rows = rows.withColumn("k", F.explode(F.sequence(F.expr("lo div cell"), F.expr("(hi - 1) div cell"))))
    rows = rows.withColumns({"x": _raw(F.greatest("lo", F.col("k") * F.col("cell"))), "end": _raw((F.col("k") + 1) * F.col("cell"))})
    one = lambda incoming: F.max(F.when(F.col("incoming") == incoming, F.struct("id", "epoch", "lo", "hi")))
    points = rows.groupBy(*ADDRESS, "k", "x").agg(one(1).alias("receipt"), one(0).alias("payment"), F.max("end").alias("end"))
    along = Window.partitionBy(*ADDRESS, "k").orderBy("x")
    carried = [F.last(c, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("receipt", "payment")]
    points = points.select(*KEYS, "x", F.coalesce(F.lead("x").over(along), "end").alias("next"), *carried)
    got = points.withColumn("y", F.least("next", "receipt.hi", "payment.hi")).where("receipt is not null and payment is not null and x < y")
    places = (("at", F.col("x") - F.col("payment.lo")), ("lo", F.col("x") - F.col("receipt.lo")), ("hi", F.col("y") - F.col("receipt.lo")))
    return got.select(*KEYS, F.col("payment.id").alias("child"), F.col("payment.epoch").alias("child_epoch"), F.col("receipt.id").alias("parent"), F.col("receipt.epoch").alias("parent_epoch"), *[_raw(c).alias(n) for n, c in places])


DIRTY = "chain string, asset string, id long, epoch long, dirty decimal(38,0)"


def _dirty_payments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tainted money of an epoch's payments, in the order of ids. The tainted part of a lot leaves it first."""
    known = {p: int(d) for p, d in zip(pdf["parent"].tolist(), pdf["dirty"], strict=True) if isinstance(d, str)}
    found: dict[int, int] = defaultdict(int)
    order = pdf["child"].argsort(kind="stable")
    for child, parent, lo, hi in zip(*[pdf[c].iloc[order].tolist() for c in ("child", "parent", "lo", "hi")], strict=True):
        bad = known.get(parent) or found.get(parent)
        if bad and bad > int(lo):
            found[child] += min(bad, int(hi)) - int(lo)
    first = pdf.iloc[0]
    return pd.DataFrame([(first["chain"], first["asset"], c, first["child_epoch"], Decimal(d)) for c, d in found.items()], columns=["chain", "asset", "id", "epoch", "dirty"])


def dirty_payments(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(chain, asset, id, epoch, dirty): `known`, which holds from the start, and the tainted money of all payments it
    reaches. An epoch needs earlier ones only: after round r epoch r is final, and later ones have what is known so far."""
    last, found, state = edges.agg(F.max("child_epoch")).first()[0], None, None
    for r in range(0 if last is None else last + 1):
        given = known.select(*KEYS, F.col("id").alias("parent"), F.lit(-1).cast("long").alias("_epoch"), "dirty")
        if found is not None:
            given = given.unionByName(found.select(*KEYS, F.col("id").alias("parent"), F.col("epoch").alias("_epoch"), "dirty"))
        given = given.withColumnsRenamed({c: f"_{c}" for c in (*KEYS, "parent")})
        same = [F.col(c) == F.col(f"_{c}") for c in (*KEYS, "parent")] + [F.col("_epoch") < F.col("child_epoch")]
        todo = edges.where(F.col("child_epoch") >= r).join(given, same, "left")
        todo = todo.select(*KEYS, "child", "child_epoch", "parent", *[F.col(c).cast("string").alias(c) for c in ("lo", "hi", "dirty")])
        fresh = todo.groupBy(*KEYS, "child_epoch").applyInPandas(_dirty_payments, DIRTY)
        old, found = found, cut(fresh if found is None else fresh.unionByName(found.where(F.col("epoch") < r)), "dirty")
        if old is not None:
            release(old)
        now = tuple(found.agg(F.count("*"), F.sum("dirty")).first())
        if now == state:
            break
        state = now
    return known if found is None else known.unionByName(found)


TAINT = ("chain", "asset", "address", "policy", "held", "touched", "unresolved")


def taint(ledger: DataFrame, seeds: DataFrame, opening: DataFrame | None = None, epoch: int = EPOCH) -> DataFrame:
    """First in, first out taint by address and asset: tainted money held, tainted money that ever arrived, and money spent
    beyond what was known, for addresses that any reached. seeds: (chain, asset, address, amount or null for all it sends);
    opening: (chain, asset, address, amount)."""
    touched = seeds.select(F.col("chain").alias("_c"), F.coalesce("asset", F.lit("")).alias("_a")).distinct()  # no other asset can be tainted
    paid = transfers(ledger.join(touched, (F.col("chain") == F.col("_c")) & (F.coalesce("asset", F.lit("")) == F.col("_a")), "left_semi"), epoch)
    endless = seeds.where("amount is null").select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "address").distinct()
    start = start_lots(seeds, opening)
    axis = axes(paid, start, endless)
    edges = cut(funding(axis), "funding")
    sent = paid.join(endless.withColumnRenamed("address", "sender"), [*KEYS, "sender"], "left_semi").select(*KEYS, "id", "epoch", F.col("amount").alias("dirty"))
    known = cut(start.where("dirty").select(*KEYS, "id", F.lit(-1).cast("long").alias("epoch"), F.col("amount").alias("dirty")).unionByName(sent), "known")
    dirty = dirty_payments(edges, known).select(*KEYS, "id", "dirty")
    spent = axis.where("incoming = 0").groupBy(*ADDRESS).agg(F.max("hi").alias("spent"))
    lots = axis.where("incoming = 1").join(dirty, [*KEYS, "id"]).join(spent, ADDRESS, "left")
    gone = F.least(F.col("dirty"), F.greatest(F.lit(0).cast(RAW), F.coalesce("spent", F.lit(0).cast(RAW)) - F.col("lo")))
    got = lots.groupBy(*ADDRESS).agg(_raw(F.sum(F.col("dirty") - gone)).alias("held"), _raw(F.sum(F.when(F.col("id") >= 0, F.col("dirty")).otherwise(F.lit(0).cast(RAW)))).alias("touched"))
    lacked = axis.groupBy(*ADDRESS).agg(F.max("lacking").alias("unresolved"))
    return got.where("held > 0 or touched > 0").join(lacked, ADDRESS).select(*ADDRESS, F.lit("fifo").alias("policy"), "held", "touched", "unresolved")


TRACED = "chain string, asset string, id long, epoch long, lo decimal(38,0), hi decimal(38,0), done boolean"


def _traced(epoch: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def trace(key: tuple, edges: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        """Parts of an epoch's payments followed back to payments of earlier epochs, or to what their sender lacked (done)."""
        sources: dict[int, list[tuple]] = defaultdict(list)
        for child, parent, at, lo, hi, from_ in zip(*[edges[c].tolist() for c in ("child", "parent", "at", "lo", "hi", "parent_epoch")], strict=True):
            sources[child].append((int(at), parent, int(lo), int(hi), from_))
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, lo, hi in zip(pieces["id"].tolist(), pieces["lo"], pieces["hi"], strict=True):
            open_[i].append((int(lo), int(hi)))
        out: list[tuple] = []
        while open_:
            child = max(open_)  # ids rise with time, so all that leads to it is known
            merged: list[list[int]] = []
            for lo, hi in sorted(open_.pop(child)):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                at = lo
                for start, parent, p_lo, p_hi, from_ in sorted(sources.get(child, ())):
                    a, b = max(lo, start), min(hi, start + p_hi - p_lo)
                    if a < b:
                        if at < a:
                            out.append((child, epoch, at, a, True))
                        at = b
                        part = (p_lo + a - start, p_lo + b - start)
                        if from_ == epoch:
                            open_[parent].append(part)
                        else:
                            out.append((parent, from_, *part, False))
                if at < hi:
                    out.append((child, epoch, at, hi, True))
        return pd.DataFrame([(key[0], key[1], i, e, Decimal(lo), Decimal(hi), done) for i, e, lo, hi, done in out], columns=["chain", "asset", "id", "epoch", "lo", "hi", "done"])

    return trace


def origins(ledger: DataFrame, target: str, amount: int | None = None, epoch: int = EPOCH) -> DataFrame:
    """Where the money that a target holds came from, per asset: the furthest senders inside the ledger, newest money first
    up to an amount."""
    paid = transfers(ledger, epoch)
    axis = axes(paid)
    edges = cut(funding(axis), "funding")
    own = axis.where(F.col("address") == target)
    ends = own.groupBy(*KEYS).agg(F.max(F.when(F.col("incoming") == 0, F.col("hi"))).alias("spent"), F.max(F.when(F.col("incoming") == 1, F.col("hi"))).alias("end"))
    low = F.coalesce("spent", F.lit(0).cast(RAW))
    low = low if amount is None else F.greatest(low, F.col("end") - F.lit(str(amount)).cast(RAW))
    held = own.where("incoming = 1").join(ends, KEYS).withColumn("from_", F.greatest(F.lit(0).cast(RAW), low - F.col("lo"))).where("from_ < hi - lo")
    todo = cut(held.select(*KEYS, "id", "epoch", _raw(F.col("from_")).alias("lo"), _raw(F.col("hi") - F.col("lo")).alias("hi"), F.lit(False).alias("done")), "pieces")
    while (at := todo.where("not done").agg(F.max("epoch")).first()[0]) is not None:
        now = todo.where(~F.col("done") & (F.col("epoch") == at))
        near = edges.where(F.col("child_epoch") == at).join(now.select(*KEYS).distinct(), KEYS, "left_semi")
        names = lambda df, cs: df.select(*KEYS, *[F.col(c).cast("string").alias(c) if c in ("at", "lo", "hi") else F.col(c) for c in cs])
        back = names(near, ("child", "parent", "parent_epoch", "at", "lo", "hi")).groupBy(*KEYS).cogroup(names(now, ("id", "lo", "hi")).groupBy(*KEYS)).applyInPandas(_traced(at), TRACED)
        old, todo = todo, cut(back.unionByName(todo.where(F.col("done") | (F.col("epoch") != at))), "pieces")
        release(old)
    first = todo.join(paid.select(*KEYS, "id", F.col("sender").alias("origin")), [*KEYS, "id"])
    return first.groupBy(*KEYS, "origin").agg(_raw(F.sum(F.col("hi") - F.col("lo"))).alias("amount_raw"))
