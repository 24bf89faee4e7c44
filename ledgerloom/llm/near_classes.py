"""Connected classes of near duplicates from lists of documents that may be alike, without expanding lists into pairs.

What operators on shingle sets share: documents told apart by (id, text), one text of each different set, exact verification
on whole sets, and classes from lists. A list's pivot is its least member; all lists with one pivot are merged into that
pivot's neighbourhood, which is compared with the pivot first. Verified links merge members into classes. Then some members
of each neighbourhood, about equally many however large it is, meet those of other classes. What is left meets in pairs (in a large
neighbourhood block by block): members of different classes of a neighbourhood, at least one of them outside the largest class. Before any text is read,
sizes and sketches must allow a link. Classes grow step by step: new links are first contracted to the classes they join,
so later rounds see the few that cross. Joins inside the loops are merge joins by hint: small tables then don't pile up as
broadcasts on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from .base import WORD_PATTERN, release, shingle_sets, stored, stored_in_small_batches

#: Members of a neighbourhood that meet all others before what is left meets in pairs.
PIVOTS = 16
#: Neighbourhoods of more members than this meet in blocks of so many members by so many others.
DENSE, BLOCK, OTHERS = 64, 1024, 1 << 14
#: Bytes of shingle sets that a verifying task keeps at hand.
KEPT_SETS = 16 << 20
#: Maps of 32768 bits each that say which texts pairs name.
MAPS = 256
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 32


@dataclass(frozen=True)
class Link:
    """When two sets link, and what may say before their texts are read that they can't: `quick` over the columns `sketch`
    of both sides (x..., y...), then `thorough`, which may also read the columns `wide`."""

    width: int
    percent: int
    sketch: tuple[str, ...]
    quick: Callable[[], Column]
    wide: tuple[str, ...] = ()
    thorough: Callable[[], Column] | None = None

    def sizes_allow(self) -> Column:
        return F.expr(f"100 * least(xn, yn) >= {self.percent} * greatest(xn, yn)")


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def parity_words(s: np.ndarray) -> np.ndarray:
    """A parity sketch: each element that two sets don't share flips one of its bits."""
    return parity(s, 64 * SKETCH_WORDS).view(np.int64)


def sketch_distance(a: str, b: str) -> Column:
    """Bits in which two sketches differ: at most the elements in one of the sets only."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH_WORDS)])


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): tid tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")


def first_row() -> Column:
    """The least row of a group, null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid"))


def matching(docs: DataFrame, chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """docs' rows that `chosen` (doc_id, tid, ...) names, one for each, with chosen's other columns."""
    rest = [c for c in chosen.columns if c not in ("doc_id", "tid")]
    named = chosen.select(F.col("doc_id").alias("_near_doc"), F.col("tid").alias("_near_tid"), *rest)
    got = docs.join(named, (F.xxhash64(docs["text"]) == F.col("_near_tid")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_near_doc")))
    twice = sets.groupBy("doc_id", "tid").count().where("count > 1").limit(1).count()
    return got.dropDuplicates(["_near_doc", "_near_tid"]) if twice else got


def one_text_each(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(ref, text): one text of each set that isn't empty, so copies cost nothing later."""
    first = sets.where("n > 0").groupBy("ref").agg(first_row().alias("r")).select("r.doc_id", "r.tid", "ref")
    return matching(docs.select("doc_id", "text"), first, sets).select("ref", "text")


def may_be_named(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts (ref, text) that pairs (a, b) name, and by chance some others: bits of all ends of pairs go to all tasks, a
    fixed size however many pairs there are, so that texts which no pair needs aren't shuffled."""
    width = 32768
    ends = pairs.select(F.explode(F.array("a", "b")).alias("ref")).select(F.pmod("ref", F.lit(MAPS * width)).alias("at"))
    maps = ends.groupBy(F.expr(f"at div {width}").alias("map")).agg(F.bitmap_construct_agg(F.expr(f"at % {width}")).alias("bits"))
    told = texts.withColumn("at", F.pmod("ref", F.lit(MAPS * width))).withColumn("map", F.expr(f"at div {width}")).join(F.broadcast(maps), "map")
    byte = f"cast(conv(hex(substring(bits, cast(at % {width} div 8 + 1 as int), 1)), 16, 10) as int)"
    return told.where(f"bit_get({byte}, cast(at % 8 as int)) = 1").select(*texts.columns)


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, both, either) of pairs (a, b): exact sizes of intersection and union."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            known: dict[int, np.ndarray] = {}
            room = KEPT_SETS

            def of(ref: int, text: str) -> np.ndarray:
                nonlocal room
                got = known.get(ref)
                if got is None:
                    got = shingle_sets([text.encode().lower()], width)[0]
                    if room < got.nbytes:
                        known.clear()
                        room = KEPT_SETS
                    known[ref] = got
                    room -= got.nbytes
                return got

            both, either = [], []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x, y = of(a, ta), of(b, tb)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                either.append(len(x) + len(y) - both[-1])
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "both": np.array(both, np.int64), "either": np.array(either, np.int64)})

    texts = may_be_named(texts, pairs)
    b = pairs.join(texts.select(F.col("ref").alias("b"), F.col("text").alias("tb")), "b")
    return b.join(texts.select(F.col("ref").alias("a"), F.col("text").alias("ta")), "a").mapInPandas(run, "a long, b long, both long, either long")


def _small_stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of each batch as stars (u, v): what is connected inside a batch hangs on its least member."""
    for pdf in frames:
        nodes, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        root, old = np.arange(len(nodes)), None
        while old is None or (root != old).any():
            old, low = root, np.minimum(root[a], root[b])
            root = root.copy()
            np.minimum.at(root, old[a], low)
            np.minimum.at(root, old[b], low)
            root = root[root]
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def components(links: DataFrame) -> DataFrame:
    """(ref, comp) of all ends of links (a, b): comp is the least ref reachable."""
    edges = stars(links.select("a", "b").where("a <> b").mapInPandas(_small_stars, "u long, v long").distinct())
    roots = edges.select(F.col("v").alias("ref"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("ref"), F.col("v").alias("comp")).unionByName(roots)


def joined_classes(classes: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """classes (ref, comp) after more links: those that cross classes are contracted to the classes' ids first."""
    if classes is None:
        return stored(components(links), name)
    if links.isEmpty():
        return classes
    a, b = (classes.select(F.col("ref").alias(k), F.col("comp").alias(f"{k}_comp")).hint("merge") for k in "ab")
    ends = links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    ends = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b")
    top = stored(components(ends), f"{name}-top")
    fresh = top.join(classes.select("ref").hint("merge"), "ref", "left_anti")
    moved = classes.join(top.select(F.col("ref").alias("comp"), F.col("comp").alias("new")).hint("merge"), "comp", "left")
    out = stored(moved.select("ref", F.coalesce("new", "comp").alias("comp")).unionByName(fresh), name)
    release(classes, top)
    return out


def met_in_blocks(rows: DataFrame, link: Link) -> DataFrame:
    """Pairs (a, b) of rows (a, ref, n, comp, minor, members, words): those of different classes of a neighbourhood, one side
    at least outside its largest class, that sizes and sketches allow. A neighbourhood's members are dealt to blocks, each of
    which meets the others block by block (numpy inside tasks), so no task has more than one block's share of it."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[~pdf["x"]].sort_values("n", kind="stable")
        x, ref, n, comp = pdf[pdf["x"]], *(y[c].to_numpy(np.int64) for c in ("ref", "n", "comp"))
        major, words = ~y["minor"].to_numpy(bool), np.array([*y["words"]], np.int64).reshape(len(y), -1).view(np.uint64)  # of signed numbers numpy counts the bits without sign
        found = []
        for own, size, mine, sketch in zip(x["ref"], x["n"], x["comp"], x["words"], strict=True):
            lo, hi = np.searchsorted(100 * n, link.percent * size), np.searchsorted(link.percent * n, 100 * size, side="right")
            differ = np.bitwise_count(words[lo:hi] ^ np.asarray(sketch, np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = (100 + link.percent) * differ <= (100 - link.percent) * (n[lo:hi] + size)
            near &= (comp[lo:hi] != mine) & (major[lo:hi] | (ref[lo:hi] > own))
            found += [(min(own, other), max(own, other)) for other in ref[lo:hi][near].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    blocks, others = (F.ceil(F.col("members") / size).cast("int") for size in (BLOCK, OTHERS))
    each, part = F.sequence(F.lit(0), blocks - 1), F.sequence(F.lit(0), others - 1)
    x = rows.where("minor").withColumns({"x": F.lit(True), "i": F.pmod(F.xxhash64("ref"), blocks).cast("int")}).withColumn("j", F.explode(part))
    y = rows.withColumns({"x": F.lit(False), "j": F.pmod(F.xxhash64("ref", F.lit(1)), others).cast("int")}).withColumn("i", F.explode(each))
    # a number that is asked for isn't merged by adaptive execution, which sees few bytes where there is much to compare
    both = x.unionByName(y).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "i", "j")
    return both.groupBy("a", "i", "j").applyInPandas(compare, "a long, b long")


def linked_classes(lists: DataFrame, sets: DataFrame, texts: DataFrame, link: Link) -> DataFrame:
    """(ref, comp) of all sets that link with another one: the classes of all links between different sets. lists: a stored
    table (lid, ref) in which two linked sets are together at least once; it is released. sets: (ref, n, sketches), rows of
    a ref alike; texts: (ref, text)."""
    wanted = lists.select("ref").distinct()
    own = sets.where("n > 0").join(wanted.hint("merge"), "ref", "left_semi").groupBy("ref").agg(*[F.min(c).alias(c) for c in ("n", *link.sketch, *link.wide)])
    own = stored(own, "sketches")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b), each once, that sizes and sketches allow."""
        x, y = (own.select(*[F.col(c).alias(side + c) for c in own.columns]).hint("merge") for side in ("x", "y"))
        near = pairs.distinct().join(y, F.col("b") == F.col("yref")).join(x, F.col("a") == F.col("xref"))
        near = near.where(link.sizes_allow() & link.quick())
        near = stored((near.where(link.thorough()) if link.thorough else near).select("a", "b"), f"{name}-pairs")
        found = stored_in_small_batches(verified(near, texts, link.width).where(f"100 * both >= {link.percent} * either").select("a", "b"), name)
        release(near)
        return found

    # a list's pivot is its least member, so all lists with one pivot are one neighbourhood that holds their pairs
    pivots = lists.groupBy("lid").agg(F.min("ref").alias("a"))
    around = stored(lists.join(pivots.hint("merge"), "lid").select("a", F.col("ref").alias("b")).distinct(), "neighbourhoods")
    release(lists)
    classes = joined_classes(None, checked(around.where("a <> b"), "links-1"), "classes-1")

    def open_rows(rows: DataFrame) -> DataFrame:
        """rows (a, ref) of neighbourhoods with several classes: class, members, whether outside the largest class."""
        placed = rows.join(classes.hint("merge"), "ref", "left").withColumn("comp", F.coalesce("comp", "ref"))
        main = placed.groupBy("a", "comp").agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("comp", F.col("c")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("members")).where("k > 1")
        return placed.join(main.select("a", "main", "members").hint("merge"), "a").withColumn("minor", F.col("comp") != F.col("main")).drop("main")

    def meet(left: DataFrame, right: DataFrame, once: str) -> DataFrame:
        """Pairs (a, b) of different classes of a neighbourhood that sizes and sketches allow."""
        x, y = (side.select("a", *[F.col(c).alias(k + c) for c in ("ref", "n", "comp", "minor", "pivot", *link.sketch)]) for k, side in (("x", left), ("y", right)))
        got = x.join(y.hint("merge"), "a").where(F.expr(f"xcomp <> ycomp and {once}") & link.sizes_allow() & link.quick())
        return got.select(F.least("xref", "yref").alias("a"), F.greatest("xref", "yref").alias("b"))

    # about PIVOTS members of each open neighbourhood, by hash, meet the others: that leaves few classes of a large one
    rest = open_rows(around.withColumnRenamed("b", "ref")).join(own.drop(*link.wide).hint("merge"), "ref")
    rest = stored(rest.withColumn("pivot", F.pmod(F.xxhash64("ref"), F.ceil(F.col("members") / PIVOTS)) == 0), "open-1")
    classes = joined_classes(classes, checked(meet(rest.where("pivot"), rest, "(not ypivot or xref < yref)"), "links-2"), "classes-2")
    # one side is outside the neighbourhood's largest class; of two such sides each pair comes once
    left = stored(open_rows(rest.select("a", "ref", "n", "pivot", *link.sketch)), "open-2")
    release(around, rest)
    few, dense = left.where(f"members <= {DENSE}"), left.where(f"members > {DENSE} and not pivot")
    last = meet(few.where("minor"), few, "not (xpivot or ypivot) and (not yminor or xref < yref)").unionByName(met_in_blocks(dense, link))
    classes = joined_classes(classes, checked(last, "links-3"), "classes-3")
    release(left, own)
    return classes


def with_classes(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(ref, comp, component_id, the class's least row) of each set that isn't empty; linked: (ref, comp)."""
    classes = sets.where("n > 0").groupBy("ref").agg(first_row().alias("row"), F.min("doc_id").alias("least")).join(linked.hint("merge"), "ref", "left").withColumn("comp", F.coalesce("comp", "ref"))
    whole = classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("row").alias("row"))
    return classes.select("ref", "comp").join(whole.hint("merge"), "comp")


def documents_of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document; one with an empty set is its own class."""
    full = sets.where("n > 0").join(classes.select("ref", "component_id").hint("merge"), "ref").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def least_of_each(docs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents (all columns) with the least id of each class, one row of each; documents without words stay."""
    empty = F.coalesce(~docs["text"].rlike(WORD_PATTERN), F.lit(True))
    kept = matching(docs.where(~empty), classes.select("row.doc_id", "row.tid").distinct(), sets.where("n > 0"))
    return kept.select([docs[c] for c in docs.columns]).unionByName(docs.where(empty))
