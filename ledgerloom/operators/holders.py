"""Which addresses of a list belong together, by kinds of links, and the funding graph that they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .clusters import ancestry, batch_funded, deposit_addresses, first_funders
from .graph import connected


def funding_graph(funders: DataFrame) -> DataFrame:
    """(funder, funded): how many addresses each one was first to fund, over the whole ledger."""
    return funders.groupBy("funder").agg(F.count("*").alias("funded"))


def _stars(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """(a, b, kind): members that share `by` linked to the least of them, so a group costs its rows once."""
    least = rows.groupBy(by).agg(F.min("member").alias("b"), F.count_distinct("member").alias("n")).where("n > 1")
    return rows.join(least, by).where("member <> b").select(F.col("member").alias("a"), "b", F.lit(kind).alias("kind")).distinct()


def holder_links(addresses: DataFrame, ledger: DataFrame, min_degree: int = 3, degree_share: float = 0.25, max_depth: int = 3, batch_blocks: int = 25, batch_ratio: float = 0.9, max_senders: int = 5) -> DataFrame:
    """(a, b, kind) between addresses of the list: they paid each other; one funded the other, at once or over several
    hops; they share a funder or ancestor, a deposit address, or were funded in one batch. An outside address that
    funded at least max(min_degree, degree_share of the list) others is a service: walks end there and it links
    nobody."""
    wanted = cut(addresses.select(F.col("address").alias("member")).distinct())
    funders = cut(first_funders(ledger))
    bar = max(min_degree, degree_share * wanted.count())
    outside = funding_graph(funders).join(wanted, F.col("funder") == F.col("member"), "left_anti")
    services = cut(outside.where(F.col("funded") >= bar).select(F.col("funder").alias("address")))
    rows = ledger.where("sender is not null and recipient is not null and sender <> recipient").select("sender", "recipient")
    paying = cut(rows.join(wanted, F.col("sender") == F.col("member"), "left_semi").distinct())  # both kinds of links read it
    inside = paying.join(wanted, F.col("recipient") == F.col("member"), "left_semi")
    found = [inside.select(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b"), F.lit("direct").alias("kind")).distinct()]
    up = ancestry(funders, services, max_depth).join(wanted, F.col("address") == F.col("member"), "left_semi")
    up = cut(up.join(services.select(F.col("address").alias("ancestor")), "ancestor", "left_anti"))
    own = up.join(wanted, F.col("ancestor") == F.col("member"), "left_semi")
    found.append(own.where("ancestor <> address").select(F.col("address").alias("a"), F.col("ancestor").alias("b"), F.when(F.col("generation") == 1, "funded_by_member").otherwise("common_ancestor").alias("kind")))
    shared = up.join(wanted, F.col("ancestor") == F.col("member"), "left_anti").select("ancestor", F.col("address").alias("member"), "generation")
    found.append(_stars(shared.where("generation = 1"), "ancestor", "shared_funder"))
    found.append(_stars(shared, "ancestor", "common_ancestor"))
    deposits = deposit_addresses(ledger, services, max_senders).select(F.col("address").alias("recipient"))
    paid = paying.join(deposits, "recipient", "left_semi").select("recipient", F.col("sender").alias("member"))
    found.append(_stars(paid, "recipient", "shared_deposit"))
    listed = funders.join(wanted, F.col("address") == F.col("member"), "left_semi")
    found.append(batch_funded(listed, batch_blocks, batch_ratio, None).select("a", "b", F.lit("batch_funded").alias("kind")))
    return reduce(DataFrame.unionByName, found)


def holders(addresses: DataFrame, ledger: DataFrame, **limits: float) -> DataFrame:
    """(address, holder, size): the groups that the links make; holder is the least member's address."""
    links = cut(holder_links(addresses, ledger, **limits).select("a", "b").distinct())
    groups = connected(links).select(F.col("node").alias("address"), F.col("component").alias("holder"))
    got = addresses.select("address").distinct().join(groups, "address", "left").withColumn("holder", F.coalesce("holder", "address"))
    sizes = got.groupBy("holder").agg(F.count("*").alias("size"))
    return got.join(sizes, "holder").select("address", "holder", "size")
