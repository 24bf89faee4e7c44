"""Conversation repair against plain versions: all edit sequences of short conversations, and a search over whole ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from ledgerloom.llm import queries, structure_repair

TURNS = "conv_id long, turn long, role string, text string, seq int, whole string, cost double, items string, digest int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """(cost, audit, repaired) of short conversations: every choice of edits, with up to two insertions in each gap."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for edits in product(*[["D"] if must else ["D", "K", "Ru", "Ra"] for _, _, must, _ in rows]):
        for inserts in product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                out += [(r, "") for r in inserts[k]]
                audit += "I" * len(inserts[k])
                cost += 2 * len(inserts[k])
                if k < len(rows):
                    role, text, _, cut = rows[k]
                    audit += edits[k][0]
                    cost += {"D": 3, "K": 0, "R": 2}[edits[k][0]] + (edits[k] != "D" and cut)
                    if edits[k] != "D":
                        out.append(({"K": role, "Ru": "user", "Ra": "assistant"}[edits[k]], text))
            if all(r for r, _ in out) and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def searched(rows):
    """The same by (cost, audit) pairs over suffixes, for conversations of any length."""
    step = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for r in ("user", "assistant"):
                if (state, r[0]) in step:
                    got = best(i, step[state, r[0]], inserts + 1)
                    if got:
                        found.append((got[0] + 2, "I" + got[1], ((r, ""), *got[2])))
        if i < len(rows):
            role, text, must, cut = rows[i]
            got = best(i + 1, state, 0)
            if got:
                found.append((got[0] + 3, "D" + got[1], got[2]))
            for letter, r, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if not must and (state, r[:1]) in step:
                    got = best(i + 1, step[state, r[:1]], 0)
                    if got:
                        found.append((got[0] + cost + cut, letter + got[1], ((r, text), *got[2])))
        return min(found) if found else None

    for i in range(len(rows), -1, -1):  # shallow recursion
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain(rows, damage=True, solve=searched):
    """The contract's row for each conversation of (conv_id, turn, role, text) rows."""
    convs, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, items, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            items.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, got = solve(tuple(items))
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, turns):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randrange(1, turns + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Umpire"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 1]), role, rng.choice(["Yes.", "No!", "cut off", " ", "", None, "Yes.", "a?\n ", "é", f"text {rng.randrange(30)}."])))
    return rows


def of(spark, rows, damage=True, **blocks):
    table = spark.createDataFrame([(*r, 1, "w", 2.0, "i", 3) for r in rows], TURNS)
    turns = structure_repair.damaged(table) if damage else table
    return sorted((tuple(r) for r in structure_repair.of_all(table, turns, **blocks).collect()), key=str)


def test_the_search_equals_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = tuple((rng.choice(["user", "assistant", "system", "tool"]), str(k), rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randrange(0, 4)))
        got, want = searched(rows), enumerated(rows)
        assert (got[0], got[1], list(got[2])) == want


def test_driver_table_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_structure_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("block_turns", [1, 3, 2048])
def test_blocks_of_any_size_equal_plain(spark, block_turns):
    """Nulls, empty roles and texts, ties, repeated rows; conversations over several blocks and partitions."""
    rows = made(block_turns, 40, 14)
    rows += rows[::7] + [(None, 0, "user", "Who?"), (None, None, None, None), (None, 1, "assistant", "Me.")]
    assert of(spark, rows, block_turns=block_turns) == plain(rows)


def test_one_conversation_holds_most_rows(spark):
    """Its turns lie in many blocks; a text that repeats in it and equal rows are counted, not gathered."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"t{t}.", f"t{t}"])) for t in range(900)]
    rows += [(1, 5, "user", "Again and again.")] * 300 + made(4, 5, 6)
    assert of(spark, rows, block_turns=16) == plain(rows)
    blocks = structure_repair.packed(spark.createDataFrame([(*r, 1, "w", 2.0, "i", 3) for r in rows], TURNS), 16).where("conv_id = 1")
    assert blocks.count() >= 900 / 16 and blocks.selectExpr("max(size(items))").first()[0] <= 18


def test_long_texts_close_blocks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "word " * 2000 + "end.") for t in range(30)] + [(2, 0, "user", "x")]
    assert of(spark, rows, damage=False, block_bytes=30_000) == plain(rows, damage=False)


def test_everything_lost(spark):
    rows = [(c, t, "user", "Gone.") for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = of(spark, rows)
    assert got and {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert of(spark, []) == []


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    rows = made(11, 60, 9) + [(None, 0, "user", "Who?"), (None, None, None, None)]
    spark.createDataFrame([(*r, 1, "w", 2.0, "i", 3) for r in rows], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(structure_repair.SQL)
    order = [c[0] for c in want.description]
    got = queries.op11_structure_repair(spark, str(tmp_path)).select(order).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
