"""Conversation structure repair by a backward cost-to-go DP and a greedy forward walk.

Edits per turn: Keep costs 0, Rerole (to user or assistant) 2, Delete 3 (required for blank and duplicate turns), Insert (a
turn with empty text, anywhere) 2; a truncated turn that isn't deleted adds 1. The cheapest edits are wanted after which
the roles' initials read `(s?(ua)+)?`; of equally cheap ones the ASCII-least audit (the edits' initials in order).
Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. The backward pass gives the cost to go from each turn and
state; every transition whose cost closes the gap between both ends is tight; the walk takes the tight edit with the least
letter, which is the least audit, as from a state each letter leads to one other.

A conversation may be any length. Its turns are range-partitioned in their order and packed in blocks of bounded rows and
bytes. A conversation that lies in one block inside a partition is solved where it is packed. Of the others each block
yields a 4 x 4 min-plus matrix; a stream over a conversation's blocks in falling order carries the cost to go back, all
blocks then walk from all four states at once, a rising stream picks each block's state, and the blocks write their edits.
Streams hold one block's figures at a time. Only the digest of a whole conversation passes its text through one task, as a
digest is sequential; it, too, holds one block at a time.

Defined cases: null roles and texts are one space (so such a text is blank); turns are taken by ascending turn, nulls first,
equal turns by role and then by the sha256 of their text; equal rows are collapsed with their count before anything is
shuffled by order; roles count by their first character, and a role whose initial isn't s, u or a (also an empty one) can't
be kept; null conversation ids are one conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD_PATTERN, stored_in_small_batches

#: Turns and bytes of texts that a block holds at most (a longer single turn extends it).
BLOCK_TURNS, BLOCK_BYTES = 2048, 4 << 20
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: The state that an inserted or reroled turn leads to, and its role; costs to go at the end of a conversation.
AHEAD, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
AT_END = [0, 2 * INSERT, INSERT, 0]
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60

TURN = "struct<role:string,text:string>"
SUMMARY = "head string, tail string, illegal long, blank long, duplicate long, truncated long, first_turn long, last_turn long, n_turns long"
PACKED = f"conv_id long, part int, seq int, whole boolean, {SUMMARY}, cost long, edits string, turns array<{TURN}>, matrix array<long>, items array<struct<deleted:long,truncated:boolean,role:string,text:string>>"
_FIGURES = [x.split(" ")[0] for x in SUMMARY.split(", ")]

_LONG, _TEXT, _BOOL = pa.int64(), pa.string(), pa.bool_()
_TURNS = pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)]))
_ITEMS = pa.list_(pa.struct([("deleted", _LONG), ("truncated", _BOOL), ("role", _TEXT), ("text", _TEXT)]))
_SUMMARY = [(c, _TEXT if c in ("head", "tail") else _LONG) for c in _FIGURES]
_BLOCK = [("conv_id", _LONG), ("part", pa.int32()), ("seq", pa.int32())]
_PACKED = pa.schema([*_BLOCK, ("whole", _BOOL), *_SUMMARY, ("cost", _LONG), ("edits", _TEXT), ("turns", _TURNS), ("matrix", pa.list_(_LONG)), ("items", _ITEMS)])


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, copies), by crc32 of `conv_id:turn` modulo 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    got = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"))
    return got.where("kind <> 0").drop("kind")


# --- one block: items are (deleted, truncated, role, text); deleted: so many turns that must go, 0 for a turn to decide on


def costs_to_go(items: Sequence[tuple], end: Sequence[int]) -> list[list[int]]:
    """The least cost from before each item and each state, given the costs at the block's end."""
    v, out = list(end), [list(end)]
    for deleted, truncated, role, _ in reversed(items):
        if deleted:
            e = [c + DELETE * deleted for c in v]
        else:
            keeps, extra = KEEPS.get(role[:1], {}), TRUNCATED * truncated
            e = [min(DELETE + v[s], REROLE + extra + v[AHEAD[s]], extra + v[keeps[s]] if s in keeps else FAR) for s in range(4)]
        v = [min(e[0], INSERT + e[2], 2 * INSERT + e[3]), min(e[1], INSERT + e[2], 2 * INSERT + e[3]), min(e[2], INSERT + e[3]), min(e[3], INSERT + e[2])]
        out.append(v)
    return out[::-1]


def walk(items: Sequence[tuple], end: Sequence[int], state: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """(edits, repaired turns, state at the end) of a block from a state; last: what is open at the end is closed."""
    cost, edits, turns = costs_to_go(items, end), [], []
    for (deleted, truncated, role, text), here, there in zip(items, cost, cost[1:], strict=False):
        if deleted:  # deletions sort before insertions and commute with them
            edits.append("D" * deleted)
            continue
        keeps, extra = KEEPS.get(role[:1], {}), TRUNCATED * truncated
        while DELETE + there[state] != here[state] and INSERT + here[AHEAD[state]] == here[state]:
            state = AHEAD[state]
            edits.append("I")
            turns.append((ROLE[state], ""))
        if DELETE + there[state] == here[state]:
            edits.append("D")
            continue
        keep = state in keeps and extra + there[keeps[state]] == here[state]
        state = keeps[state] if keep else AHEAD[state]
        edits.append("K" if keep else "R")
        turns.append((role if keep else ROLE[state], text))
    while last and state in (1, 2):
        state = AHEAD[state]
        edits.append("I")
        turns.append((ROLE[state], ""))
    return "".join(edits), turns, state


def matrix(items: Sequence[tuple]) -> list[int]:
    """The least costs from each state before the block (rows) to each after it."""
    ends = [costs_to_go(items, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
    return [min(ends[t][s], FAR) for s in range(4) for t in range(4)]


def _before(m: Sequence[int], end: Sequence[int]) -> list[int]:
    return [min(m[4 * s + t] + end[t] for t in range(4)) for s in range(4)]


# --- packing


class _Packer:
    """Blocks of the conversations of one partition, whose rows come in order."""

    def __init__(self, part: int, turns: int, most: int):
        self.part, self.turns, self.most, self.seq = part, turns, most, 0
        self.conv: object = self  # none yet
        self.inside = False
        self._clear()

    def _clear(self) -> None:
        self.items: list[tuple] = []
        self.bytes = self.illegal = self.blank = self.duplicate = self.truncated = self.n_turns = 0
        self.head = self.tail = self.first_turn = self.last_turn = None

    def add(self, conv: object, turn: int | None, role: str, text: str, count: int, blank: bool, cut: bool, first: bool) -> Iterator[dict]:
        if conv != self.conv:
            yield from self.flush(self.inside)
            self.inside, self.conv = self.conv is not self, conv
        elif len(self.items) >= self.turns or self.bytes >= self.most:
            yield from self.flush(False)
            self.inside = False
        initial = role[:1]
        self.illegal += (self.tail is not None and self.tail + initial not in LEGAL) + count - 1
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None:
            self.n_turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        alive = first and not blank
        if blank:
            self.blank += count
        else:
            self.duplicate += count - alive
        if alive:
            self.truncated += cut
            self.items.append((0, cut, role, text))
            self.bytes += len(text)
        if count > alive:
            self.items.append((count - alive, False, role, None))

    def flush(self, whole: bool) -> Iterator[dict]:
        if not self.items:
            return
        row = {"conv_id": self.conv, "part": self.part, "seq": self.seq, "whole": whole} | {c: getattr(self, c) for c in _FIGURES}
        if whole:
            edits, turns, _ = walk(self.items, AT_END, 0, True)
            row |= {"cost": costs_to_go(self.items, AT_END)[0][0], "edits": edits, "turns": [{"role": r, "text": t} for r, t in turns]}
        else:
            row |= {"matrix": matrix(self.items), "items": [dict(zip(("deleted", "truncated", "role", "text"), x, strict=True)) for x in self.items]}
        yield row
        self.seq += 1
        self._clear()


def _emitted(rows: Iterable[dict], schema: pa.Schema, most: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(x["text"] or "") for x in [*(row.get("items") or ()), *(row.get("turns") or ())])
        if len(held) >= most or held_bytes >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, held_bytes = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def packed(turns: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of turns in order, stored: whole conversations are repaired already, others have items and a matrix."""
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), copies.cast("long").alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    order = ("conv_id", "turn", "role", "digest")
    data = rows.groupBy(*order, "text").agg(F.sum("copies").alias("count"))
    data = data.select(*order, F.lit(1).alias("mark"), "text", "count", (~F.col("text").rlike(WORD_PATTERN)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    # a mark stands before the first turn of each role and text, so that no text is moved to find duplicates
    marks = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    marks = marks.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("mark"), *[F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("count", "long"), ("blank", "boolean"), ("cut", "boolean"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), block_turns, block_bytes)

        def blocks() -> Iterator[dict]:
            marked = None
            for batch in batches:
                for conv, turn, role, digest, mark, text, count, blank, cut in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if not mark:
                        marked = (conv, turn, role, digest)
                    else:
                        yield from packer.add(conv, turn, role, text, count, blank, cut, marked == (conv, turn, role, digest))
            yield from packer.flush(False)

        yield from _emitted(blocks(), _PACKED)

    ordered = data.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "mark")
    return stored_in_small_batches(ordered.mapInArrow(pack, PACKED), "blocks")


# --- conversations of several blocks


def _streamed(blocks: DataFrame, rising: bool, f: Callable[[Iterator[dict]], Iterator[dict]], names: str, schema: pa.Schema) -> DataFrame:
    """f over rows that come conversation by conversation, each in the order of its blocks."""
    sort = [F.col(c).asc() if rising else F.col(c).desc() for c in ("conv_id", "part", "seq")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(f(row for batch in batches for row in batch.to_pylist()), schema)

    return blocks.repartition("conv_id").sortWithinPartitions(*sort).mapInArrow(run, names)


def _ends(rows: Iterator[dict]) -> Iterator[dict]:
    """The cost to go at the end of each block, in falling order."""
    conv, begun, v = None, False, AT_END
    for r in rows:
        if not begun or r["conv_id"] != conv:
            conv, begun, v = r["conv_id"], True, AT_END
            last = True
        yield {c: r[c] for c in ("conv_id", "part", "seq")} | {"ends": v, "last": last}
        v, last = _before(r["matrix"], v), False


def _states(rows: Iterator[dict]) -> Iterator[dict]:
    """The state that each block begins in, in rising order."""
    conv, begun, state = None, False, 0
    for r in rows:
        if not begun or r["conv_id"] != conv:
            conv, begun, state = r["conv_id"], True, 0
        yield {c: r[c] for c in ("conv_id", "part", "seq")} | {"state": state}
        state = r["leads"][state]


def _walked(row: dict, state: int) -> tuple[str, list[tuple[str, str]], int]:
    return walk([(x["deleted"], x["truncated"], x["role"], x["text"]) for x in row["items"]], row["ends"], state, row["last"])


def _each(blocks: DataFrame, f: Callable[[dict], dict], names: str, schema: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _emitted((f(row) for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()), schema)

    return blocks.mapInArrow(run, names)


def repaired(turns: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, part, seq, whole, the block's figures, cost, edits, turns): the repaired turns of each conversation in blocks
    that (part, seq) orders; `whole` blocks are conversations."""
    blocks = packed(turns, block_turns, block_bytes)
    parted, names = blocks.where("not whole"), "conv_id long, part int, seq int"
    ends = _streamed(parted.select("conv_id", "part", "seq", "matrix"), False, _ends, f"{names}, ends array<long>, last boolean", pa.schema([*_BLOCK, ("ends", pa.list_(_LONG)), ("last", _BOOL)]))
    open_ = stored_in_small_batches(parted.drop("conv_id", "edits", "turns", "cost").join(ends.hint("merge"), ["part", "seq"]), "blocks-open")
    leads = _each(open_, lambda r: {c: r[c] for c in ("conv_id", "part", "seq")} | {"leads": [_walked(r, s)[2] for s in range(4)]}, f"{names}, leads array<int>", pa.schema([*_BLOCK, ("leads", pa.list_(pa.int32()))]))
    states = _streamed(leads, True, _states, f"{names}, state int", pa.schema([*_BLOCK, ("state", pa.int32())]))

    def written(row: dict) -> dict:
        edits, got, _ = _walked(row, row["state"])
        own = {c: row[c] for c in ("conv_id", "part", "seq", *_FIGURES)}
        return own | {"whole": False, "cost": _before(row["matrix"], row["ends"])[0], "edits": edits, "turns": [{"role": r, "text": t} for r, t in got]}

    kept = [c for c in blocks.columns if c not in ("matrix", "items")]
    schema = pa.schema([_PACKED.field(c) for c in kept])
    pieces = _each(open_.join(states.drop("conv_id").hint("merge"), ["part", "seq"]), written, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(kept).schema), schema)
    return blocks.where("whole").select(kept).unionByName(pieces)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(rows: Iterator[dict]) -> Iterator[dict]:
    """A row for each conversation out of its blocks in rising order; texts go through the digest one block at a time."""
    out, digest, any_turn, first, n, tail, last, audit = None, None, False, None, 0, None, None, []

    def done() -> dict:
        return out | {"gaps": 0 if first is None else last - first + 1 - n, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for r in rows:
        if out is None or r["conv_id"] != out["conv_id"]:
            if out is not None:
                yield done()
            out, digest, any_turn = {"conv_id": r["conv_id"], "cost": r["cost"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, hashlib.sha256(), False
            first, n, tail, last, audit = None, 0, None, None, []
        for c in ("blank", "duplicate", "truncated", "illegal"):
            out[c] += r[c]
        out["illegal"] += tail is not None and tail + r["head"] not in LEGAL
        tail = r["tail"]
        if r["first_turn"] is not None:
            n += r["n_turns"] - (r["first_turn"] == last)
            first, last = r["first_turn"] if first is None else first, r["last_turn"]
        audit.append(r["edits"])
        for t in r["turns"]:
            digest.update(f"{'\n' if any_turn else ''}{t['role']}:{t['text']}".encode())
            any_turn = True
    if out is not None:
        yield done()


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation that has turns: what was found, the audit and the digest of the repaired conversation."""
    text = F.concat_ws("\n", F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    names = [x.split(" ")[0] for x in REPORT.split(", ")]
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    schema = pa.schema([(c, _TEXT if c in ("audit", "repaired_sha256") else _LONG) for c in names])
    return whole.unionByName(_streamed(pieces.where("not whole"), True, _reports, REPORT, schema))


def of_all(conversations: DataFrame, turns: DataFrame, **blocks: int) -> DataFrame:
    """The report of `turns` for every conversation of a table, also those that have no turns left."""
    got = report(repaired(turns, **blocks))
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    columns: list[Column] = [F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in got.columns if c != "conv_id"]
    return ids.join(got, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *columns)


def repaired_report(conversations: DataFrame) -> DataFrame:
    return of_all(conversations, damaged(conversations))


def _best(options: Sequence[str]) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _option(cost: str, edits: str, turns: str, then: str, given: str = "true") -> str:
    return f"CASE WHEN {given} THEN {{'c': {cost} + {then}.c, 'e': '{edits}' || {then}.e, 't': {turns} || {then}.t}} END"


def _row_options(state: int) -> str:
    keeps = [_option("cut", "K", "[role || ':' || txt]", f"v{ahead[state]}", f"NOT must AND role[1] = '{x}'") for x, ahead in KEEPS.items() if state in ahead]
    ahead = AHEAD[state]
    return _best([_option("3", "D", "[]::VARCHAR[]", f"v{state}"), *keeps, _option("2 + cut", "R", f"['{ROLE[ahead]}:' || txt]", f"v{ahead}", "NOT must")])


def _insertions(state: int) -> str:
    first, second = AHEAD[state], AHEAD[AHEAD[state]]
    return _best([f"e{state}", _option("2", "I", f"['{ROLE[first]}:']", f"e{first}"), _option("4", "II", f"['{ROLE[first]}:', '{ROLE[second]}:']", f"e{second}")])


#: The same by (cost, audit, turns) carried back over the rows of all conversations at once.
SQL = f"""WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || [1::BIGINT, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(txt)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
p AS (SELECT *, NOT regexp_matches(txt, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 AS again, NOT regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
f AS (SELECT *, blank OR again AS must, (open AND NOT blank AND NOT again)::INT AS cut FROM p),
r AS (SELECT DISTINCT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS v0, {{'c': 4::BIGINT, 'e': 'II', 't': ['user:', 'assistant:']}} AS v1, {{'c': 2::BIGINT, 'e': 'I', 't': ['assistant:']}} AS v2, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS v3 FROM f
  UNION ALL SELECT conv_id, i, {", ".join(_insertions(s) for s in range(4))} FROM (SELECT f.conv_id, f.i, {", ".join(f"{_row_options(s)} AS e{s}" for s in range(4))} FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i - 1)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE i > 1 AND was[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
x AS (SELECT DISTINCT conv_id FROM conversations)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.e, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM x LEFT JOIN g ON x.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN (SELECT * FROM r WHERE i = 1) AS r ON x.conv_id IS NOT DISTINCT FROM r.conv_id"""
