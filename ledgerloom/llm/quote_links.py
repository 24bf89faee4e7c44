"""Chat formatting by quotation linking.

Lines that start with `>` are quotes; their level is the number of `>`. Runs of lines of one level are passages.
Normalised passages (and their single lines) are hashed and joined to the earlier message of the same conversation
that wrote them itself, the latest if several did. A message replies to the message that most of its outermost
passages come from (the later one at a tie), else to the turn before it. Conversations come out in reply order,
without quotes: depth first through the tree of replies, the replies to a message in the order of their turns.

Messages that each answer the one before are a branch; a message that answers an earlier one by a quote starts a new
branch at that message. The tree of branches is small and is walked by pointer doubling: a branch of depth d has its
path after log2(d) rounds. Depth first means that a branch comes whole, then the branches that leave it, those that
leave it last first; so a path is a list of (place where it leaves, descending; its first turn).

The link to the latest earlier writer is a running maximum over writers and quoters of a hash, not a join of all
writers with all quoters, so a line that thousands repeat costs its rows once. Running maxima and positions in a
conversation come from blocks of turns plus what the blocks before them carry, so a conversation with a third of all
rows is split.

Defined cases: null and empty texts have no passages and stay as empty messages; null roles pass through; messages
with a null conversation are one conversation; null turns come first; rows with the same conversation and turn are
one after another, ordered by role and text, and are alike as reply targets; quotes of unknown origin are counted
and removed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import release, stored

BLOCK = 256  # turns of a conversation that are ranked together
_QUOTE = r"^(?:[ \t]*>)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTE, "")), r"[\x20\x09-\x0D]+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without separators at its ends."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(_QUOTE))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash): hashes of each run of lines of one level, and of each of its lines."""
    lines = messages.select("conv", "turn", "mid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    lines = lines.select("conv", "turn", "mid", "i", _level(F.col("line")).alias("level"), _plain(F.col("line")).alias("plain")).where("plain <> ''")
    inside = Window.partitionBy("mid").orderBy("i")
    lines = lines.withColumn("run", F.sum(F.when(F.col("level") == F.lag("level").over(inside), 0).otherwise(1)).over(inside))
    runs = lines.groupBy("mid", "conv", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("i", "plain"))).alias("ls"))
    whole = F.array_join(F.transform("ls", lambda x: x["plain"]), " ")
    every = F.array_distinct(F.concat(F.array(whole), F.transform("ls", lambda x: x["plain"])))
    return runs.select("conv", "turn", "mid", "level", F.explode(F.transform(every, lambda x: F.md5(x.cast("binary")))).alias("hash"))


def _messages(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return rows.withColumn("mid", F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("conv", "turn", "role", "text")]).cast("binary")))


def reply_targets(messages: DataFrame) -> DataFrame:
    """(mid, target, n_quotes, n_linked) of messages with quotes."""
    quoted = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    convs = quoted.select("conv").distinct()
    near = messages.join(convs, messages["conv"].eqNullSafe(convs["conv"]), "left_semi")
    found = stored(passages(near), "passages")
    found = found.withColumns({"writes": F.when(F.col("level") == 0, F.col("turn")), "k": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)})
    before = Window.partitionBy("conv", "hash", "k").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    inside = found.withColumn("near", F.max("writes").over(before)).where("level > 0")
    ahead = Window.partitionBy("conv", "hash").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("conv", "hash", "k").agg(F.max("writes").alias("writes")).withColumn("far", F.max("writes").over(ahead))
    blocks = blocks.where("far is not null").select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("k").alias("b"), "far")
    linked = inside.join(blocks, inside["conv"].eqNullSafe(F.col("c")) & (inside["hash"] == F.col("h")) & (inside["k"] == F.col("b")), "left")
    linked = linked.withColumn("writer", F.coalesce("near", "far"))
    vote = linked.groupBy("mid", "writer").agg(F.count(F.when(F.col("level") == 1, 1)).alias("votes"), F.count("*").alias("n"))
    best = F.max(F.when(F.col("writer").isNotNull() & (F.col("votes") > 0), F.struct("votes", "writer")))["writer"]
    return vote.groupBy("mid").agg(best.alias("target"), F.sum("n").alias("n_quotes"), F.coalesce(F.sum(F.when(F.col("writer").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"))


def _numbered(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], ties: tuple[str, ...], name: str) -> DataFrame:
    """rows with a position from 0 in their group, by blocks of `order`'s last column."""
    rows = rows.withColumn("_k", F.floor(F.coalesce(F.col(order[-1]), F.lit(-1)) / BLOCK))
    keys = [*group, *order[:-1], "_k"]
    inner = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, *ties)])
    offset = rows.groupBy(*keys).agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in (*order[:-1], "_k")]).rowsBetween(Window.unboundedPreceding, -1)
    offset = offset.withColumn("_o", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    a, b = rows.withColumn("_r", F.row_number().over(inner) - 1).alias("a"), offset.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    return a.join(b, on).select("a.*", (F.col("a._r") + F.col("b._o")).alias(name)).drop("_k", "_r")


def _branch_paths(branches: DataFrame) -> DataFrame:
    """(conv, start, path, depth) of branches (conv, start, up: the branch it leaves or null, leaves: where)."""
    own = F.when(F.col("up").isNotNull(), F.array(F.struct((-F.col("leaves")).alias("leaves"), F.col("start").alias("start"))))
    at = stored(branches.select("conv", "start", "up", F.coalesce(own, F.array().cast("array<struct<leaves:long,start:long>>")).alias("path")), "branches")
    while at.where("up is not null").limit(1).count():
        above = at.select(F.col("conv").alias("c"), F.col("start").alias("s"), F.col("up").alias("next"), F.col("path").alias("head"))
        step = at.join(above, at["conv"].eqNullSafe(F.col("c")) & (at["up"] == F.col("s")), "left")
        step = step.select("conv", "start", F.col("next").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"))
        old, at = at, stored(step, "branches")
        release(old)
    return at.select("conv", "start", "path", F.size("path").alias("depth"))


def threads(conversations: DataFrame) -> DataFrame:
    """One row per message: (conv_id, turn, role, own_text, reply_to, linked_by, root_turn, depth, n_quotes, n_linked,
    reply_order). reply_to is the turn answered; root_turn the turn at the root of its tree of replies (a
    conversation's first); depth the number of quote links that lead away from a branch on the way from there."""
    messages = _messages(conversations)
    targets = reply_targets(messages)
    rows = messages.join(targets, "mid", "left").withColumn("own_text", own_text(F.col("text"))).drop("text")
    rows = stored(_numbered(rows, ("conv",), ("turn",), ("role", "own_text"), "seq"), "messages")
    turns = rows.select(F.col("conv").alias("c"), (F.col("seq") + 1).alias("s"), F.col("turn").alias("previous"))
    rows = rows.join(turns, rows["conv"].eqNullSafe(F.col("c")) & (rows["seq"] == F.col("s")), "left").drop("c", "s")
    # a branch starts with a conversation, and where a linked quote leads away from the turn before
    starts = (F.col("seq") == 0) | (F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("previous")))
    rows = rows.withColumns({"_b": F.floor(F.col("seq") / BLOCK), "lead": F.when(starts, F.col("seq"))})
    # the branch a message is on is the latest start at or before it: inside its block of turns, else from earlier blocks
    rows = rows.withColumn("own", F.last("lead", ignorenulls=True).over(Window.partitionBy("conv", "_b").orderBy("seq")))
    ahead = Window.partitionBy("conv").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "_b").agg(F.max("lead").alias("lead"), F.min("turn").alias("first"))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("_b").alias("k"), F.last("lead", ignorenulls=True).over(ahead).alias("carried"), F.min("first").over(Window.partitionBy("conv")).alias("first"))
    rows = rows.join(blocks, rows["conv"].eqNullSafe(F.col("c")) & (rows["_b"] == F.col("k"))).drop("c", "k", "_b")
    rows = stored(rows.withColumn("start", F.coalesce("own", "carried")).drop("own", "carried"), "messages-branches")
    # where a branch leaves: the first message of the turn that it answers, and that message's branch
    left = rows.where("lead is not null and seq > 0").select("conv", F.col("seq").alias("start"), "target")
    places = rows.groupBy(F.col("conv").alias("c"), F.col("turn").alias("t")).agg(F.min(F.struct("seq", "start")).alias("place"))
    left = left.join(places, left["conv"].eqNullSafe(F.col("c")) & (left["target"] == F.col("t"))).select("conv", "start", F.col("place.start").alias("up"), F.col("place.seq").alias("leaves"))
    roots = rows.where("seq = 0").select("conv", "start", F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("leaves"))
    paths = _branch_paths(left.unionByName(roots)).select(F.col("conv").alias("c"), F.col("start").alias("s"), "path", "depth")
    # branches are placed by their paths, messages by their branch's place and their own in it
    sizes = rows.groupBy("conv", "start").agg(F.count("*").alias("n"))
    placed = sizes.join(paths, sizes["conv"].eqNullSafe(F.col("c")) & (sizes["start"] == F.col("s"))).drop("c", "s")
    along = Window.partitionBy("conv").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("conv").alias("c"), F.col("start").alias("s"), "depth", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    rows = rows.join(placed, rows["conv"].eqNullSafe(F.col("c")) & (rows["start"] == F.col("s"))).drop("c", "s")
    rows = rows.withColumns({"reply_order": F.col("ahead") + F.col("seq") - F.col("start"), "reply_to": F.coalesce("target", "previous")})
    how = F.when(F.col("target").isNotNull(), "quote").when(F.col("reply_to").isNotNull(), "previous")
    return rows.select(F.col("conv").alias("conv_id"), "turn", "role", "own_text", "reply_to", how.alias("linked_by"), F.col("first").alias("root_turn"), "depth", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("reply_order").cast("long").alias("reply_order"))
