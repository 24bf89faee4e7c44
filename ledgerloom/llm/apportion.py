"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Each source's words, in a seeded order of its documents, form a line that is cut into equal-token
blocks; the block length follows from the corpus, so that there are about `blocks` of them at every size. Blocks of
the mix are seats: they go to sources by the highest quotients target / (2k + 1), which also deals them to shards in
turn, so every shard has an integer quota of each source. Then a source's shards take their quotas, one shard after
another, along a second seeded order of the source's blocks, again from the front when all are taken, so a block is
taken at most twice when targets stop at twice the size. What whole blocks leave of a target, or take beyond it, is
settled in words inside the source: the next block in that order is taken in part, or the last one is cut. So a
source ends at its target to the word, also one that is too small for any seat.

`mix` gives the words taken of each document, which may be part of one. `mixed_documents` takes documents whole: it
walks the same order of blocks, each with the documents that start in it, until the source's target is met.

What is gathered in one place are the sources and the seats, never documents: positions of documents in their source's
line come from running sums inside hash buckets plus the buckets' offsets, so a source with a third of all rows is
spread like any other.

The sources themselves are sorted in one task (their weights follow their order), so their number is taken to be
moderate: a million sources are a million narrow rows there.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; documents without
words take nothing; a table without words takes nothing; repeated rows (same id and text) take neighbouring places;
extra columns pass through `mixed_documents` and are ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD_PATTERN, stored

BLOCKS = 32768
SHARE = 1.5
CAP = 2
WEIGHTS = (5, 2, 1)
SHARDS = 16
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, and in the sources' order: code points (Spark compares UTF-8 bytes), null last."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(skey, source_size) with weight and target. Sources whose weighted share exceeds cap times their size get
    that; the excess goes to the others by weight. In order of cap over weight the capped ones come first, so running
    sums find where the capping ends without rounds."""
    everything = Window.partitionBy(F.lit(0))
    got = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(everything.orderBy("skey")) - 1) % len(weights) + 1).cast("int")).cast("double"))
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    most = F.lit(float(cap)) * F.col("source_size")
    got = (
        got.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left_size", F.lit(share) * F.col("total") - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= most)
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("skey"), F.col("level")))).over(everything)["level"]
    return got.withColumn("target", F.least(most, F.coalesce(level * F.col("weight"), most))).select("skey", "source_size", "weight", "target", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(BLOCKS)))).cast("long").alias("block"))


def seats(targets: DataFrame, share: float = SHARE, cap: int = CAP, shards: int = SHARDS) -> DataFrame:
    """One row for each block of the mix: (skey, k, shard). Bounded by the number of blocks, not by the data."""
    everything = Window.partitionBy(F.lit(0))
    n_blocks = F.ceil(F.col("source_size") / F.col("block"))
    bid = targets.withColumn("wanted", F.round(F.sum("target").over(everything) / F.col("block")).cast("long")).where(F.col("target") > 0)
    bid = bid.withColumn("k", F.explode(F.sequence(F.lit(0), (F.lit(cap) * n_blocks - 1).cast("int"))))
    rank = F.row_number().over(everything.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "skey", "k"))
    return bid.withColumn("seat", rank).where(F.col("seat") <= F.col("wanted")).select("skey", F.col("k").cast("long").alias("k"), ((F.col("seat") - 1) % shards).cast("int").alias("shard"))


def shard_quotas(taken: DataFrame) -> DataFrame:
    """(skey, shard, quota, first): blocks of each source in each shard of the mix, and the shards before it."""
    quotas = taken.groupBy("skey", "shard").agg(F.count("*").alias("quota"))
    ahead = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return quotas.withColumn("first", F.coalesce(F.sum("quota").over(ahead), F.lit(0)))


def _order(of: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), of).cast("binary"))


def _document_order(seed: str) -> Column:
    """Place of a document in its source's line: by id and text, so that documents without an id, or of one id, are spread
    like others."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return _order(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), seed)


def positions(sized: DataFrame) -> DataFrame:
    """sized(doc_id, skey, size, order) with `start`: words before the document in its source's line."""
    rows = sized.withColumn("_b", F.substring("order", 1, 3))
    inside = Window.partitionBy("skey", "_b").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("skey", "_b").agg(F.sum("size").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("skey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_s", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(buckets.select("skey", "_b", offset.alias("_before")), ["skey", "_b"]).withColumn("start", F.col("_s") + F.col("_before")).drop("_b", "_s", "_before")


def _n_blocks() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long")


def _block_rank(seed: str) -> Column:
    """Place of a source's block in the second seeded order, from 0."""
    name = F.concat(F.col("skey.none").cast("string"), F.lit(":"), F.col("skey.name"), F.lit(":"), F.col("b").cast("string"))
    return F.row_number().over(Window.partitionBy("skey").orderBy(_order(name, seed), "b")) - 1


def block_table(targets: DataFrame, quotas: DataFrame, seed: str = SEED) -> DataFrame:
    """One row for each block of each source, at least one a source: words taken of it by the first and the second
    turn, words taken before it in the line, and the shards that take it."""
    rows = targets.withColumn("n", _n_blocks()).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("rank", _block_rank(seed)).withColumn("words", F.least(F.col("block"), F.col("source_size") - F.col("b") * F.col("block")))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.round("target").cast("long") - ahead
    for turn, rest in (("take1", left), ("take2", left - F.col("source_size"))):
        rows = rows.withColumn(turn, F.greatest(F.lit(0), F.least(rest, F.col("words"))))
    before = F.coalesce(F.sum(F.col("take1") + F.col("take2")).over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = quotas.groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("first", "quota", "shard"))).alias("shares"))

    def owner(seat: Column) -> Column:
        """The shard whose quota holds a seat; what is settled beyond the seats goes with the last one."""
        inside = F.filter("shares", lambda x: (x["first"] <= seat) & (seat < x["first"] + x["quota"]))
        return F.coalesce(F.try_element_at(inside, F.lit(1)), F.try_element_at("shares", F.lit(-1)))["shard"]

    rows = rows.withColumn("before", before).join(shares, "skey", "left")
    shards = F.array_compact(F.array(F.when(F.col("take1") > 0, owner(F.col("rank"))), F.when(F.col("take2") > 0, owner(F.col("rank") + F.col("n")))))
    return rows.select("skey", "source_size", "target", "block", "n", "b", "take1", "take2", "before", shards.alias("shards"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", _source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), _document_order(seed).alias("order"))


def mix_plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, skey, size, start, source_size, target, taken, shards): each document's place and words in the mix, and
    the shards that take the block it starts in."""
    sized = stored(_sized(docs, seed), "sizes")  # read four times below; the texts only here
    targets = stored(with_targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size"))), "targets")
    blocks = stored(block_table(targets, shard_quotas(seats(targets)), seed), "blocks")
    lines = targets.select("skey", "block", _n_blocks().alias("n"))
    got = positions(sized).withColumn("end", F.col("start") + F.col("size")).join(lines, "skey")
    for side in ("start", "end"):
        # a document without words at the end of the line starts behind the last block: it belongs to that one
        got = got.withColumn("b", F.least(F.floor(F.col(side) / F.col("block")).cast("long"), F.col("n") - 1))
        own = ["skey", "b", "take1", "take2", "before"] + (["source_size", "target", "shards"] if side == "start" else [])
        inside = F.col(side) - F.col("b") * F.col("block")
        taken = F.col("before") + F.least(inside, F.col("take1")) + F.least(inside, F.col("take2"))
        got = got.join(blocks.select(own), ["skey", "b"]).withColumn(f"_{side}", taken).drop("b", "take1", "take2", "before")
    return got.select("doc_id", "skey", "size", "start", "source_size", "target", (F.col("_end") - F.col("_start")).alias("taken"), "shards")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return mix_plan(docs, seed).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def document_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, skey, size, order, source_size, target, copies): how often the mix holds each document, whole. A source's blocks
    are walked twice in their seeded order, each with the documents that start in it and their whole sizes; a document
    is in while its middle is within the target, so that a source ends within half a document of its target, however
    small it is and however large the others are."""
    sized = stored(_sized(docs, seed), "sizes")  # read four times below; the texts only here
    targets = stored(with_targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size"))), "targets")
    lines = targets.select("skey", "source_size", "target", "block", _n_blocks().alias("n"))
    places = positions(sized).join(lines, "skey")
    places = stored(places.withColumn("b", F.least(F.floor(F.col("start") / F.col("block")).cast("long"), F.col("n") - 1)), "places")
    whole = places.groupBy("skey", "b").agg(F.sum("size").alias("words"), F.min("start").alias("first")).withColumn("rank", _block_rank(seed))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = places.join(whole.select("skey", "b", "first", ahead.alias("ahead")), ["skey", "b"])
    middle = F.col("ahead") + F.col("start") - F.col("first") + F.col("size") / F.lit(2.0)
    copies = (middle <= F.col("target")).cast("int") + (middle + F.col("source_size") <= F.col("target")).cast("int")
    return got.select("doc_id", "skey", "size", "order", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as documents: each is there whole, unchanged, as often as it is taken (0, 1 or 2 times)."""
    plan = document_copies(docs, seed)
    # repeated rows of an id, text and source are counted off, so that each has its own place
    same = Window.partitionBy("order", "skey")
    plan = plan.where("size > 0").withColumn("nth", F.row_number().over(same.orderBy(F.desc("copies")))).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), n_words(F.col("text")).alias("size"), _document_order(seed).alias("order"), _source_key(F.col("source")).alias("skey"))
    rows = rows.where("size > 0").withColumn("nth", F.row_number().over(same.orderBy("size")))
    plan = plan.select(*[F.col(c).alias(f"p_{c}") for c in ("order", "skey", "nth", "copies")])
    got = rows.join(plan, F.expr("order = p_order and skey = p_skey and nth = p_nth"))
    return got.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("p_copies")))).select("row.*")


#: The same mix for DuckDB; the window over a whole source is fine there.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
src AS (SELECT none, name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY none, encode(name)) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
            (sum(source_size) OVER ())::DOUBLE AS total FROM src),
levels AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, none, encode(name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT none, name, source_size, least(2.0::DOUBLE * source_size, coalesce(
    (SELECT level FROM levels WHERE level * weight <= 2.0::DOUBLE * source_size ORDER BY source_size / weight, none, encode(name) LIMIT 1) * weight, 2.0::DOUBLE * source_size)) AS target,
    greatest(1, ceil(total / 32768.0::DOUBLE))::BIGINT AS block FROM levels),
bids AS (SELECT none, name, source_size, block, k, target / (2 * k + 1) AS quotient, (SELECT round(sum(target) / max(block)) FROM target)::BIGINT AS wanted
  FROM target, unnest(range(0, 2 * ceil(source_size / block)::BIGINT)) AS u(k) WHERE target > 0),
seat AS (SELECT none, name, (s - 1) % 16 AS shard FROM (SELECT none, name, wanted, row_number() OVER (ORDER BY quotient DESC, none, encode(name), k) AS s FROM bids) WHERE s <= wanted),
quota AS (SELECT *, coalesce(sum(quota) OVER (PARTITION BY none, name ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT none, name, shard, count(*) AS quota FROM seat GROUP BY ALL)),
shares AS (SELECT none, name, list({'first': first, 'quota': quota, 'shard': shard} ORDER BY first) AS shares FROM quota GROUP BY ALL),
blocks AS (SELECT none, name, source_size, target, block, greatest(1, ceil(source_size / block))::BIGINT AS n, unnest(range(0, greatest(1, ceil(source_size / block))::BIGINT)) AS b FROM target),
ranked AS (SELECT *, least(block, source_size - b * block) AS words, row_number() OVER (PARTITION BY none, name ORDER BY md5('mix-1:' || none::VARCHAR || ':' || name || ':' || b::VARCHAR), b) - 1 AS rank FROM blocks),
left_over AS (SELECT *, round(target)::BIGINT - coalesce(sum(words) OVER (PARTITION BY none, name ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM ranked),
takes AS (SELECT *, greatest(0, least(rest, words)) AS take1, greatest(0, least(rest - source_size, words)) AS take2 FROM left_over),
owned AS (SELECT t.*, coalesce(list_filter(shares, lambda x: x.first <= rank AND rank < x.first + x.quota)[1].shard, shares[-1].shard) AS owner1,
  coalesce(list_filter(shares, lambda x: x.first <= rank + n AND rank + n < x.first + x.quota)[1].shard, shares[-1].shard) AS owner2
  FROM takes t LEFT JOIN shares s ON t.none = s.none AND t.name = s.name),
sums AS (SELECT *, concat_ws(',', CASE WHEN take1 > 0 THEN owner1::VARCHAR END, CASE WHEN take2 > 0 THEN owner2::VARCHAR END) AS shards,
  coalesce(sum(take1 + take2) OVER (PARTITION BY none, name ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM owned),
places AS (SELECT doc_id, none, name, size, coalesce(sum(size) OVER (PARTITION BY none, name ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
bounds AS (SELECT p.*, source_size, target, block, greatest(1, ceil(source_size / block))::BIGINT AS n FROM places p JOIN target t ON p.none = t.none AND p.name = t.name)
SELECT doc_id, p.size, p.source_size, p.target, s.shards,
  ((e.before + least(p.start + p.size - e.b * p.block, e.take1) + least(p.start + p.size - e.b * p.block, e.take2))
   - (s.before + least(p.start - s.b * p.block, s.take1) + least(p.start - s.b * p.block, s.take2)))::BIGINT AS taken
FROM bounds p
JOIN sums s ON s.none = p.none AND s.name = p.name AND s.b = least(p.start // p.block, p.n - 1)
JOIN sums e ON e.none = p.none AND e.name = p.name AND e.b = least((p.start + p.size) // p.block, p.n - 1)
"""
