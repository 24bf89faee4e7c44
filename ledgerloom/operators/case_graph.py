"""The picture of a case: nodes and edges merged from several walks, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import HIGH
from .store import RAW
from .tokens import inspected

EDGE = ("chain", "source", "target", "asset", "symbol", "decimals")


def folded_edges(*parts: DataFrame) -> DataFrame:
    """Edges of equal key (null assets are equal) as one: sums, counts, the first and the last moment."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*EDGE).agg(F.sum("total_raw").cast(RAW).alias("total_raw"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of one address as one. Each field comes from the surest row that has it (the least value at a tie); the
    result is as sure as the least sure row that gave a field; a node is expanded if any row is."""

    def pick(field: str) -> Column:
        return F.min(F.when(F.col(field).isNotNull(), F.struct((-F.coalesce("confidence", F.lit(-1))).alias("s"), F.col(field).alias("v"))))

    got = nodes.groupBy("address").agg(pick("label").alias("l"), pick("category").alias("k"), F.bool_or("expanded").alias("expanded"))
    sure = F.nullif(-F.greatest("l.s", "k.s"), F.lit(-1))
    return got.select("address", F.col("l.v").alias("label"), F.col("k.v").alias("category"), sure.alias("confidence"), "expanded")


def totals(edges: DataFrame) -> DataFrame:
    """Sums by asset, symbol and decimals: units are never mixed."""
    return edges.groupBy("asset", "symbol", "decimals").agg(F.sum("total_raw").cast(RAW).alias("total_raw"), F.sum("n").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, frontier (not expanded), unlabelled, labelled with high confidence, sanctioned."""
    counts = nodes.agg(F.count("*").alias("nodes"), F.count_if(~F.col("expanded")).alias("frontier"), F.count_if(F.col("label").isNull()).alias("unlabelled"), F.count_if(F.col("label").isNotNull() & (F.col("confidence") >= HIGH)).alias("high_confidence"), F.count_if(F.col("category") == "sanctioned").alias("sanctioned"))
    return counts.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each


def assets(edges: DataFrame) -> DataFrame:
    """Per asset: edges, transfers, and what its contract says about its symbol."""
    grouped = edges.groupBy("chain", F.lower(F.trim(F.coalesce("asset", F.lit("")))).alias("contract"), F.trim("symbol").alias("symbol")).agg(F.count("*").alias("edges"), F.sum("n").alias("transfers"))
    seen = inspected(edges.select("chain", "asset", "symbol")).select("chain", "contract", "symbol", "verdict")
    return grouped.join(seen, ["chain", "contract", "symbol"]).select("contract", "symbol", "edges", "transfers", "verdict")
