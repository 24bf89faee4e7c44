"""Taint forwards under three policies, origins backwards. First in, first out is taken over intervals (lots.py).

Under haircut and poison a payment depends on all that is held then, so transfers of an asset between addresses that are
connected by them must be folded in order. Transfers that a seed's money can't reach are removed by joins first; what is left falls
apart into connected components, and a component of a chain and asset is the unit of parallel work: its payments pass one task in
order, a batch at a time, which keeps only what addresses hold.
Amounts are Python integers inside the fold: exact at any size.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, release
from . import lots
from .graph import connected

POLICIES = ("fifo", "haircut", "poison")
KEYS = ("chain", "asset")


#: Hops that are followed before what was reached is written and compared.
HOPS_A_ROUND = 4


def reachable(ledger: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chain, asset, address) that a seed's money can reach: payments at or after the earliest arrival, per asset.
    Rounds of a few hops go on until nothing is new or earlier, which ends as both only move one way."""
    rows = ledger.where("sender is not null and recipient is not null and amount_raw > 0").select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "sender", "recipient", F.coalesce("block", F.lit(0)).cast("long").alias("block"))
    best = rows.groupBy("chain", "asset", F.col("sender").alias("address"), "recipient").agg(F.max("block").alias("last"), F.min("block").alias("first"))
    ends = best.select(*KEYS, F.col("recipient").alias("address")).unionByName(seeds.select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "address")).distinct()
    stays = ends.select(*KEYS, "address", F.col("address").alias("recipient"), F.lit((1 << 63) - 1).alias("last"), F.lit(0).cast("long").alias("first"))
    best = cut(best.where("address <> recipient").unionByName(stays), "pairs")
    seen = cut(seeds.select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "address", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    state = None
    while True:
        now = seen.agg(F.count("*"), F.sum("at")).first()
        if now == state:
            return seen.select("chain", "asset", "address")
        state, more = now, seen
        for _ in range(HOPS_A_ROUND):
            step = more.join(best, [*KEYS, "address"]).where("last >= at").select(*KEYS, F.col("recipient").alias("address"), F.greatest("first", "at").alias("at"))
            more = step.groupBy(*KEYS, "address").agg(F.min("at").alias("at"))
        old, seen = seen, cut(more, "reached")
        release(old)


def _touching(ledger: DataFrame, near: DataFrame) -> DataFrame:
    """Transfers with an end in `near` (chain, asset, address), each row once, equal ones as often as they occur."""
    rows = ledger.where("sender is not null and recipient is not null and amount_raw > 0").withColumn("asset", F.coalesce("asset", F.lit("")))
    marked = rows
    for end in ("sender", "recipient"):
        hit = near.select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.col("address").alias("_address"), F.lit(True).alias(f"_{end}"))
        marked = marked.join(hit, [F.col(c) == F.col(f"_{c}") for c in KEYS] + [F.col(end) == F.col("_address")], "left").drop("_chain", "_asset", "_address")
    return marked.where("_sender or _recipient").drop("_sender", "_recipient")


def _in_components(rows: DataFrame) -> DataFrame:
    """rows (chain, asset, sender, recipient, ...) with `part`: the connected component of their ends."""
    node = lambda end: F.concat_ws("\x01", "chain", "asset", end)
    parts = connected(rows.where("recipient is not null").select(node("sender").alias("a"), node("recipient").alias("b")))
    named = parts.select(F.col("node").alias("_node"), F.col("component").alias("part"))
    return rows.join(named, node("sender") == F.col("_node"), "left").drop("_node")


TAINT = "chain string, asset string, address string, policy string, held decimal(38,0), touched decimal(38,0), unresolved decimal(38,0)"


class _Queue:
    """Lots of an amount and its dirty part in order, with their sums, so that a payment costs the lots it empties and no
    more. Neighbouring lots that are clean, or dirty throughout, are one: rounding sees no difference. Numbers are packed
    while they fit 64 bits."""

    __slots__ = ("bads", "dirty", "head", "sizes", "total")

    def __init__(self) -> None:
        self.sizes: array | list[int] = array("q")
        self.bads: array | list[int] = array("q")
        self.head = self.total = self.dirty = 0

    def append(self, amount: int, dirty: int) -> None:
        self.total += amount
        self.dirty += dirty
        if self.total >= 1 << 63 and isinstance(self.sizes, array):  # beyond 64 bits: plain numbers
            self.sizes, self.bads = self.sizes.tolist(), self.bads.tolist()
        if len(self.sizes) > self.head and (not dirty and not self.bads[-1] or dirty == amount and self.bads[-1] == self.sizes[-1]):
            self.sizes[-1] += amount
            self.bads[-1] += dirty
        else:
            self.sizes.append(amount)
            self.bads.append(dirty)

    def spend(self, amount: int, policy: str) -> int:
        """Take an amount (at most what is held) from the front; how much of it counts as dirty. Under haircut the share of
        all that is held moves, rounded down, while each lot gives its own share, rounded down: the difference is lost to
        rounding. Under poison all of it is dirty if anything held is."""
        total, dirty, moved, left = self.total, self.dirty, 0, amount
        sizes, bads, head = self.sizes, self.bads, self.head
        while left and head < len(sizes):
            size, bad = sizes[head], bads[head]
            part = min(left, size)
            gives = bad * part // size if policy == "haircut" else min(bad, part)
            moved += gives
            left -= part
            if part == size:
                head += 1
                self.dirty -= bad
            else:
                sizes[head] = size - part
                bads[head] = bad - gives
                self.dirty -= gives
            self.total -= part
        if head > 1024 and 2 * head > len(sizes):  # what is spent goes when it is most of the rows
            del sizes[:head], bads[:head]
            head = 0
        self.head = head
        if policy == "haircut":
            return amount * dirty // total if total else 0
        return (amount if dirty else 0) if policy == "poison" else moved

    def receive(self, amount: int, dirty: int, policy: str) -> int:
        """Add a lot; how much of it is dirty. Under poison dirty money makes all that lies there dirty (each lot once), and
        clean money that arrives at a dirty address becomes so."""
        if policy == "poison":
            if dirty and self.dirty < self.total:
                self.sizes, self.bads, self.head = self.sizes[:0], self.bads[:0], 0
                self.sizes.append(self.total)
                self.bads.append(self.total)
                self.dirty = self.total
            dirty = amount if dirty or self.dirty else 0
        dirty = min(dirty, amount)
        self.append(amount, dirty)
        return dirty


class _Fold:
    """What addresses hold after payments in order, under one policy."""

    def __init__(self, seeds: dict[str, int | None], policy: str, opening: dict[str, int] | None = None) -> None:
        self.policy = policy
        self.endless = {a for a, amount in seeds.items() if amount is None}
        self.held_by: dict[str, _Queue] = defaultdict(_Queue)
        self.touched: dict[str, int] = {}
        self.lacking: dict[str, int] = {}
        for address, amount in (opening or {}).items():
            if amount > 0:
                self.held_by[address].append(amount, 0)
        for address, amount in seeds.items():
            if amount:
                self.held_by[address].append(amount, amount)

    def take(self, rows: Iterable[tuple[str, str, int]]) -> None:
        held_by, touched, lacking, policy, endless = self.held_by, self.touched, self.lacking, self.policy, self.endless
        for sender, recipient, amount in rows:
            if sender in endless:
                moved = amount
            else:
                held, moved, known = held_by.get(sender), 0, 0
                if held is not None:
                    known = min(amount, held.total)
                    moved = held.spend(known, policy)
                if amount > known:
                    lacking[sender] = lacking.get(sender, 0) + amount - known
            dirty = held_by[recipient].receive(amount, moved, policy)
            if dirty:
                touched[recipient] = touched.get(recipient, 0) + dirty

    def result(self) -> dict[str, tuple[int, int, int]]:
        held = {a: q.dirty for a, q in self.held_by.items()}
        return {a: (held.get(a, 0), self.touched.get(a, 0), self.lacking.get(a, 0)) for a in {*held, *self.touched, *self.lacking}}


def fold_taint(rows: list[tuple[str, str, int]], seeds: dict[str, int | None], policy: str, opening: dict[str, int] | None = None) -> dict[str, tuple[int, int, int]]:
    """{address: (tainted money held, tainted money that ever arrived, money spent beyond the known balance)} after
    (sender, recipient, amount) in order. A seed with an amount starts with one tainted lot behind its opening
    balance; a seed without one taints all it sends."""
    fold = _Fold(seeds, policy, opening)
    fold.take(rows)
    return fold.result()


def _moves(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "sender", "recipient", F.col("amount_raw").cast("string").alias("amount"), F.coalesce("block", F.lit(0)).cast("long").alias("block"), F.coalesce("log_index", F.lit(0)).alias("log_index"), "tx_hash", F.lit("move").alias("kind"))


def taint(ledger: DataFrame, seeds: DataFrame, policies: tuple[str, ...] = POLICIES, opening: DataFrame | None = None) -> DataFrame:
    """Tainted money by address, asset and policy. seeds: (chain, asset, address, amount or null for all it sends);
    opening: (chain, asset, address, amount) held before the first transfer. First in, first out is taken over intervals
    (lots.py), which spreads one asset over many tasks; haircut and poison depend on all that is held at each payment and
    are folded in order."""
    by_lots = [lots.taint(ledger, seeds, opening)] if "fifo" in policies else []
    folded = [_folded(ledger, seeds, tuple(p for p in policies if p != "fifo"), opening)] if set(policies) - {"fifo"} else []
    return reduce(DataFrame.unionByName, by_lots + folded)


def _folded(ledger: DataFrame, seeds: DataFrame, policies: tuple[str, ...], opening: DataFrame | None) -> DataFrame:
    rows = _moves(_touching(ledger, reachable(ledger, seeds)))
    for kind, given in (("seed", seeds), ("opening", opening)):
        if given is not None:
            rows = rows.unionByName(given.select("chain", F.coalesce("asset", F.lit("")).alias("asset"), F.col("address").alias("sender"), F.lit(None).cast("string").alias("recipient"), F.col("amount").cast("string").alias("amount"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("log_index"), F.lit("").alias("tx_hash"), F.lit(kind).alias("kind")))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows of whole groups, a batch at a time: only what addresses hold is kept."""
        group, start, folds = None, {}, []

        def result() -> pd.DataFrame:
            done = folds or [_Fold(start["seed"], p, start["opening"]) for p in policies]
            out = [(*group[:2], address, f.policy, *map(Decimal, numbers)) for f in done for address, numbers in f.result().items() if numbers[0] or numbers[1]]
            return pd.DataFrame(out, columns=[c.split()[0] for c in TAINT.split(", ")])

        for pdf in frames:
            kinds = [pdf[c].to_numpy() for c in (*KEYS, "part", "kind")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in kinds], axis=0)) + 1).tolist(), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                at, kind = tuple(k[lo] for k in kinds[:3]), kinds[3][lo]
                if at != group:
                    if group is not None:
                        yield result()
                    group, start, folds = at, {"seed": {}, "opening": {}}, []
                senders, amounts = pdf["sender"].iloc[lo:hi], pdf["amount"].iloc[lo:hi]
                if kind != "move":
                    start[kind].update({a: None if n is None or n != n else int(n) for a, n in zip(senders, amounts, strict=True)})
                    continue
                folds = folds or [_Fold(start["seed"], p, start["opening"]) for p in policies]
                each = list(zip(senders.tolist(), pdf["recipient"].iloc[lo:hi].tolist(), map(int, amounts), strict=True))
                for f in folds:
                    f.take(each)
        if group is not None:
            yield result()

    # what one seed can reach hangs together through it, so only assets of several seeds are taken apart
    rows, several = cut(rows), seeds.select("chain", F.coalesce("asset", F.lit("")).alias("asset"), "address").distinct().groupBy(*KEYS).count().where("count > 1").select(*KEYS)
    parts = rows.join(several, [*KEYS], "left_anti").withColumn("part", F.lit(""))
    if not several.isEmpty():
        parts = parts.unionByName(_in_components(rows.join(several, [*KEYS], "left_semi")))
    order = [*KEYS, "part", F.when(F.col("kind") == "move", "").otherwise(F.col("kind")).desc(), "block", "log_index", "tx_hash", "sender", "recipient", "amount"]
    return parts.repartition(*KEYS, "part").sortWithinPartitions(*order).select(*KEYS, "part", "kind", "sender", "recipient", "amount").mapInPandas(fold, TAINT)


def agreement(tainted: DataFrame, balances: DataFrame) -> DataFrame:
    """Per address and asset the tainted share of a balance under each policy: unanimous, or contested by how much."""
    got = tainted.join(balances, ["chain", "asset", "address"]).where("balance > 0")
    share = F.least("held", "balance").cast("double") / F.col("balance").cast("double")
    by = got.groupBy("chain", "asset", "address").agg(*[F.coalesce(F.max(F.when(F.col("policy") == p, share)), F.lit(0.0)).alias(p) for p in POLICIES])
    spread = F.greatest(*POLICIES) - F.least(*POLICIES)
    return by.withColumn("spread", spread).withColumn("unanimous", spread == 0)


origins = lots.origins
