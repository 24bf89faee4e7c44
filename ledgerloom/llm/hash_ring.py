"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards have virtual nodes on a ring of 65,536 positions; a document's position is a hash of its id and it belongs to
the next virtual node clockwise. Every shard has room for an equal count of documents (at most one apart). A shard
keeps its own documents in ring order while it has room; those that overflow continue clockwise to the next virtual
node whose shard has room. So balance is exact (the law `rows`) and only the overflow moves.

Documents on one arc (between two virtual nodes) are alike up to their order, so the walk of the overflow is computed
for arcs: a few thousand counts, bounded by the ring and not by the data. Documents get their place on an arc from
ranks inside ring positions plus the positions' offsets, and read their shard and slot from the arc's pieces.

Defined cases: null or empty texts count 0 bytes plus 1; a null id hashes like the empty text; rows with the same id
share a position and are ranked by their text's checksum, equal rows in any order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import release, stored

RING = 65536
VIRTUAL = 64
SEED = "ring-1"
#: Documents of one ring position are ranked in so many parts, by their texts, so that one id's rows are split.
PARTS = 16


def _position(of: Column) -> Column:
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 4), 16, 10).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, virtual: int = VIRTUAL, seed: str = SEED) -> DataFrame:
    """(arc, shard, at): positions of the virtual nodes; where two collide the lower shard has the place."""
    nodes = spark.range(shards * virtual, numPartitions=1).select(F.floor(F.col("id") / virtual).cast("int").alias("shard"), (F.col("id") % virtual).alias("v"))
    at = nodes.select("shard", _position(F.concat(F.lit(f"{seed}:node:"), F.col("shard").cast("string"), F.lit(":"), F.col("v").cast("string"))).alias("at")).groupBy("at").agg(F.min("shard").alias("shard"))
    return at.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1).alias("arc"), "shard", "at")


def ring_positions(nodes: DataFrame) -> DataFrame:
    """(pos, arc): the arc of each ring position; behind the last node the ring closes to arc 0."""
    along = Window.partitionBy(F.lit(0)).orderBy("arc")
    ends = nodes.select("arc", (F.coalesce(F.lag("at").over(along), F.lit(-1)) + 1).alias("lo"), F.col("at").alias("hi"))
    closing = nodes.agg((F.max("at") + 1).alias("lo")).where(F.col("lo") < RING).select(F.lit(0).alias("arc"), "lo", F.lit(RING - 1).alias("hi"))
    return ends.unionByName(closing).select(F.explode(F.sequence("lo", "hi")).alias("pos"), "arc")


def arc_pieces(nodes: DataFrame, per_arc: DataFrame, shards: int) -> tuple[DataFrame, list[DataFrame]]:
    """(arc, pieces): which ranks of an arc go to which shard, and from which slot on; and the tables that it reads, for
    release. per_arc: (arc, n).

    Home documents first. A shard with room left offers it at its virtual nodes in equal parts. The overflow walks
    clockwise as a queue: from a point where nothing is under way, the k-th overflowing document takes the k-th free
    place, so running sums of both, laid over each other, give the pieces."""
    one = Window.partitionBy(F.lit(0))
    up_to_here = (Window.unboundedPreceding, -1)

    def before(of: str, within: Window) -> Column:
        return F.coalesce(F.sum(of).over(within.rowsBetween(*up_to_here)), F.lit(0))

    nodes = nodes.join(per_arc, "arc", "left").fillna(0, ["n"]).withColumn("total", F.sum("n").over(one))
    nodes = nodes.withColumn("room", (F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)).cast("long"))
    by_shard = Window.partitionBy("shard")
    nodes = nodes.withColumn("slot0", F.least(before("n", by_shard.orderBy("arc")), F.col("room"))).withColumn("home", F.least(F.col("n"), F.col("room") - F.col("slot0")))
    nodes = nodes.withColumn("used", F.sum("home").over(by_shard)).withColumn("over", F.col("n") - F.col("home"))
    free, k = F.col("room") - F.col("used"), F.row_number().over(by_shard.orderBy("arc"))
    nodes = homes = stored(nodes, "ring-homes")
    nodes = nodes.withColumn("offer", (F.floor(free / F.count("*").over(by_shard)) + F.when(k <= free % F.count("*").over(by_shard), 1).otherwise(0)).cast("long"))
    nodes = nodes.withColumn("queue", F.sum(F.col("over") - F.col("offer")).over(one.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    nodes = nodes.withColumn("calm", F.min(F.struct("queue", "arc")).over(one)["arc"])
    nodes = nodes.withColumn("turn", F.when(F.col("arc") > F.col("calm"), 0).otherwise(1))
    round_ = ("turn", "arc")
    nodes = nodes.withColumn("from_", before("over", one.orderBy(*round_))).withColumn("to_", before("offer", one.orderBy(*round_))).withColumn("slot1", F.col("used") + before("offer", by_shard.orderBy(*round_)))
    nodes = stored(nodes.withColumn("ends", F.sum("over").over(one)), "ring-walk")
    leaving = nodes.where("over > 0").select(F.col("from_").alias("x"), F.struct("arc", "home", "from_", "ends").alias("source"), F.lit(None).alias("place"))
    arriving = nodes.where("offer > 0").select(F.col("to_").alias("x"), F.lit(None).alias("source"), F.struct("shard", "slot1", "to_").alias("place"))
    marks = leaving.unionByName(arriving, allowMissingColumns=True).groupBy("x").agg(F.max("source").alias("source"), F.max("place").alias("place"))
    along = one.orderBy("x")
    marks = marks.withColumns({c: F.last(c, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in ("source", "place")})
    marks = marks.withColumn("y", F.coalesce(F.lead("x").over(along), F.col("source.ends"))).where("x < y")
    at = F.col("source.home") + F.col("x") - F.col("source.from_")
    moved = marks.select(F.col("source.arc").alias("arc"), F.col("place.shard").alias("shard"), at.alias("lo"), (at + F.col("y") - F.col("x")).alias("hi"), (F.col("place.slot1") + F.col("x") - F.col("place.to_")).alias("slot"))
    own = nodes.where("home > 0").select("arc", "shard", F.lit(0).cast("long").alias("lo"), F.col("home").alias("hi"), F.col("slot0").alias("slot"))
    return own.unionByName(moved).groupBy("arc").agg(F.collect_list(F.struct("shard", "lo", "hi", "slot")).alias("pieces")), [homes, nodes]


def assign(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' doc_id with size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(F.concat(F.lit(f"{SEED}:"), key).cast("binary")).alias("_h"))
    rows = rows.withColumns({"pos": F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), "part": F.pmod("text_crc32", F.lit(PARTS))})
    parts = docs.select(_position(F.concat(F.lit(f"{SEED}:"), key)).alias("pos"), F.pmod(F.crc32(text.cast("binary")), F.lit(PARTS)).alias("part")).groupBy("pos", "part").agg(F.count("*").alias("c"))
    within = Window.partitionBy("pos").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("ahead", F.coalesce(F.sum("c").over(within), F.lit(0))), "ring-parts")
    counts = parts.groupBy("pos").agg(F.sum("c").alias("c"))
    nodes = stored(virtual_nodes(spark, shards), "ring-nodes")
    ring = ring_positions(nodes).join(counts, "pos").withColumn("offset", F.coalesce(F.sum("c").over(Window.partitionBy("arc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ring = stored(ring, "ring-positions")
    pieces, tables = arc_pieces(nodes, ring.groupBy("arc").agg(F.sum("c").alias("n")), shards)
    plan = stored(ring.join(pieces, "arc").join(parts, "pos").select("pos", "part", (F.col("offset") + F.col("ahead")).alias("offset"), "pieces"), "ring-plan")
    release(nodes, parts, ring, *tables)
    rank = F.row_number().over(Window.partitionBy("pos", "part").orderBy("_h", "doc_id", "text_crc32", "size")) - 1
    got = rows.withColumn("_r", rank).join(plan, ["pos", "part"]).withColumn("_r", F.col("_r") + F.col("offset"))
    got = got.withColumn("_p", F.filter("pieces", lambda x: (x["lo"] <= F.col("_r")) & (F.col("_r") < x["hi"]))[0])
    return got.select("doc_id", *keep, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_p.shard").alias("shard"), (F.col("_p.slot") + F.col("_r") - F.col("_p.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
