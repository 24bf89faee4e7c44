"""Interval lots against queues that are folded in order."""

import random
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import folds, lots

ROWS = "chain string, asset string, sender string, recipient string, amount_raw decimal(38,0), block long, log_index int, tx_hash string"
HELD = "chain string, asset string, address string, amount decimal(38,0)"


def fold_origins(rows: list[tuple[str, str, int]], target: str, amount: int | None = None) -> dict[str, int]:
    """One queue of (amount, origin) lots: {furthest sender inside the window: amount} of what the target holds, newest lots first up to an amount."""
    lots: dict[str, deque[list]] = {}
    for sender, recipient, n in rows:
        queue, left = lots.setdefault(sender, deque()), n
        arrive = lots.setdefault(recipient, deque()) if recipient != sender else deque()
        while left and queue:
            part = min(left, queue[0][0])
            arrive.append([part, queue[0][1]])
            queue[0][0] -= part
            left -= part
            if not queue[0][0]:
                queue.popleft()
        if left:
            arrive.append([left, sender])
        if recipient == sender:
            queue.extend(arrive)
    out: dict[str, int] = {}
    left = amount
    for size, origin in reversed(lots.get(target, ())):
        part = size if left is None else min(size, left)
        if part:
            out[origin] = out.get(origin, 0) + part
        left = None if left is None else left - part
        if left == 0:
            break
    return out


def payments(seed, n, addresses, unit=1):
    rng = random.Random(seed)
    return [("c", rng.choice(["x", None]), f"a{rng.randrange(addresses)}", f"a{rng.randrange(addresses)}", Decimal(rng.randrange(1, 30) * unit), i // 3, i % 3, f"t{i:05d}") for i in range(n)]


@pytest.mark.parametrize(("seed", "unit", "epoch"), [(0, 1, 10**6), (1, 10**18, 17), (2, 10**30, 40)])
def test_taint_equals_the_fold(spark, seed, unit, epoch):
    rows = payments(seed, 200, 8, unit)
    given = {"a1": 40 * unit, "a2": None, "a3": 7 * unit}
    opening = {"a1": 11 * unit, "a5": 50 * unit}
    seeds = spark.createDataFrame([("c", "x", "a1", Decimal(40 * unit)), ("c", "x", "a2", None), ("c", "x", "a3", Decimal(7 * unit))], HELD)
    start = spark.createDataFrame([("c", "x", a, Decimal(n)) for a, n in opening.items()], HELD)
    got = {r.address: (int(r.held), int(r.touched), int(r.unresolved)) for r in lots.taint(spark.createDataFrame(rows, ROWS), seeds, start, epoch).collect() if r.asset == "x"}
    want = folds.fold_taint([(r[2], r[3], int(r[4])) for r in rows if r[1] == "x"], given, "fifo", opening)
    assert got == {a: v for a, v in want.items() if v[0] or v[1]}


@pytest.mark.parametrize(("amount", "epoch"), [(None, 10**6), (25, 17)])
def test_origins_equal_the_fold(spark, amount, epoch):
    rows = payments(5, 200, 8)
    got = {(r.asset, r.origin): int(r.amount_raw) for r in lots.origins(spark.createDataFrame(rows, ROWS), "a4", amount, epoch).collect()}
    want = {(a or "", o): n for a in ("x", None) for o, n in fold_origins([(r[2], r[3], int(r[4])) for r in rows if r[1] == a], "a4", amount).items()}
    assert got == want


def test_a_hub_is_spread(spark):
    """An address in all payments: no cell of its axis and no epoch holds more than a few of its rows."""
    rows = [("c", "x", "hub" if i % 2 else f"a{i}", f"b{i}" if i % 2 else "hub", Decimal(1 + i % 5), i, 0, f"t{i:05d}") for i in range(4000)]
    ledger = spark.createDataFrame(rows, ROWS)
    axis = lots.axes(lots.transfers(ledger, 500))
    edges = lots.funding(axis)
    assert edges.groupBy("child_epoch").count().agg(F.max("count")).first()[0] < 1500 and edges.count() < 8000
    seeds = spark.createDataFrame([("c", "x", "a0", None)], HELD)
    got = {r.address: int(r.held) for r in lots.taint(ledger, seeds, epoch=500).collect() if r.held}
    want = folds.fold_taint([(r[2], r[3], int(r[4])) for r in rows], {"a0": None}, "fifo")
    assert got == {a: v[0] for a, v in want.items() if v[0]}


def test_no_payments(spark):
    none = spark.createDataFrame([], ROWS)
    assert lots.taint(none, spark.createDataFrame([], HELD)).collect() == [] and lots.origins(none, "a").collect() == []
