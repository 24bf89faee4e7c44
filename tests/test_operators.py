import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import scalar
from ledgerloom.operators import asof, case_graph, clusters, folds, graph, holders, labels, ordered, peel, risk, sequences, store, tokens
from ledgerloom.plans import session, sql_surface, views
from ledgerloom.sources import label_files, logs
from ledgerloom.streaming import watches

DIR = "/root/testdata/sf0.001"

LEDGER = "chain string, tx_hash string, log_index int, sender string, recipient string, amount_raw decimal(38,0), decimals int, symbol string, asset string, kind string, block long, ts long"


def ledger(spark, rows):
    """rows: (sender, recipient, amount, block)."""
    full = [("c", f"t{i:03d}", 0, s, r, Decimal(a), 2, "X", "X", "token", b, b * 60) for i, (s, r, a, b) in enumerate(rows)]
    return spark.createDataFrame(full, LEDGER)


def test_fifo_haircut_and_poison():
    rows = [("thief", "a", 10), ("a", "b", 5)]
    got = {p: folds.fold_taint(rows, {"thief": 10}, p, {"a": 10}) for p in folds.POLICIES}
    assert got["fifo"]["a"][0] == 10 and got["fifo"]["b"][0] == 0
    # lots stay apart: the clean lot in front gives nothing, though a quarter of all that is held counts as moved
    assert (got["haircut"]["a"][0], got["haircut"]["b"][0]) == (10, 2)
    # what lay at the receiver became dirty too
    assert (got["poison"]["a"][0], got["poison"]["b"][0]) == (15, 5)


def test_poison_taints_clean_money_that_arrives_later():
    rows = [("thief", "a", 10), ("donor", "a", 10)]
    assert folds.fold_taint(rows, {"thief": 10}, "poison", {"a": 10, "donor": 10})["a"][0] == 30


def test_spending_beyond_the_known_balance():
    got = folds.fold_taint([("s", "a", 10), ("a", "b", 11)], {"s": 10}, "fifo")
    assert got["b"][0] == 10 and got["a"] == (0, 10, 1)


def spreading_economy(hops=6, width=4, unit=10**18):
    """A theft of 100 that is paid on through several hops, with clean money flowing into the same addresses."""
    rng = random.Random(20260803)
    rows, opening, front = [("thief", "a0", 100 * unit)], {f"clean{i}": 50 * unit for i in range(40)}, ["a0"]
    for hop in range(hops):
        reached = []
        for holder in front:
            for w in range(width):
                to = f"h{hop}_{holder}_{w}"
                rows += [(holder, to, 5 * unit), (f"clean{rng.randrange(40)}", to, 5 * unit)]
                reached.append(to)
        front = reached[: width * 2]
    return rows, opening


def test_taint_of_the_published_economy(spark):
    unit = 10**18
    rows, opening = spreading_economy()
    held = {p: sum(v[0] for v in folds.fold_taint(rows, {"thief": 100 * unit}, p, opening).values()) / unit for p in folds.POLICIES}
    assert {p: round(x, 1) for p, x in held.items()} == {"fifo": 100.0, "haircut": 86.4, "poison": 320.0}
    frame = ledger(spark, [(*r, k + 1) for k, r in enumerate(rows)])
    seeds = spark.createDataFrame([("c", "X", "thief", Decimal(100 * unit))], "chain string, asset string, address string, amount decimal(38,0)")
    start = spark.createDataFrame([("c", "X", a, Decimal(n)) for a, n in opening.items()], "chain string, asset string, address string, amount decimal(38,0)")
    got = folds.taint(frame, seeds, opening=start).groupBy("policy").agg(F.sum("held").alias("held")).collect()
    assert {r.policy: round(int(r.held) / unit, 1) for r in got} == {"fifo": 100.0, "haircut": 86.4, "poison": 320.0}


def brute_taint(rows, seed, policy):
    """Unit by unit: every lot is a list of single units, True if tainted (fifo and poison only)."""
    lots = {seed[0]: [True] * seed[1]}
    for s, r, n in rows:
        have = lots.setdefault(s, [])
        dirty = any(have)
        out, lots[s] = have[:n], have[n:]
        there = lots.setdefault(r, [])
        if policy == "fifo":
            arrive = [True] * sum(out) + [False] * (n - sum(out))
        else:
            arrive = [dirty or any(there)] * n
            if dirty:
                lots[r] = there = [True] * len(there)
        lots[r] = there + arrive
    return {a: sum(x) for a, x in lots.items() if sum(x)}


def test_taint_equals_unit_by_unit(spark):
    rng = random.Random(7)
    rows = [("s", "n0", 9)] + [(f"n{rng.randrange(5)}", f"n{rng.randrange(5)}", rng.randrange(1, 8)) for _ in range(60)]
    rows = [r for r in rows if r[0] != r[1]]
    for policy in ("fifo", "poison"):
        got = {a: v[0] for a, v in folds.fold_taint(rows, {"s": 9}, policy).items() if v[0]}
        assert got == brute_taint(rows, ("s", 9), policy)
    frame = ledger(spark, [(*r, k + 1) for k, r in enumerate(rows)])
    seeds = spark.createDataFrame([("c", "X", "s", 9)], "chain string, asset string, address string, amount long")
    got = {r.address: int(r.held) for r in folds.taint(frame, seeds, ("fifo",)).where("held > 0").collect()}
    assert got == brute_taint(rows, ("s", 9), "fifo")


def test_equal_transfers_count_twice(spark):
    one = ledger(spark, [("s", "a", 10, 1)])
    seeds = spark.createDataFrame([("c", "X", "s", 20)], "chain string, asset string, address string, amount long")
    got = {r.address: int(r.held) for r in folds.taint(one.unionByName(one), seeds, ("fifo",)).collect()}
    assert got["a"] == 20


def test_origins_equal_a_single_queue(spark):
    rows = [("x", "a", 5, 1), ("y", "a", 4, 2), ("a", "t", 6, 3), ("z", "t", 2, 4), ("t", "q", 1, 5)]
    got = {r.origin: int(r.amount_raw) for r in folds.origins(ledger(spark, rows), "t").collect()}
    assert got == {"x": 4, "y": 1, "z": 2}


def test_fifo_keeps_the_sum():
    rows = [("s", "a", 7), ("x", "a", 5), ("a", "b", 6), ("b", "c", 6), ("a", "c", 4)]
    got = folds.fold_taint(rows, {"s": 7}, "fifo", {"x": 5})
    assert sum(v[0] for v in got.values()) == 7


def test_taint_job(spark):
    rows = ledger(spark, [("s", "a", 10, 1), ("a", "b", 10, 2), ("y", "z", 3, 3)])
    seeds = spark.createDataFrame([("c", "X", "s", None)], "chain string, asset string, address string, amount long")
    got = {(r.address, r.policy): int(r.held) for r in folds.taint(rows, seeds).collect()}
    assert got == {(a, p): h for p in folds.POLICIES for a, h in (("a", 0), ("b", 10))}


def test_taint_follows_long_relays(spark):
    rows = ledger(spark, [(f"a{i}", f"a{i + 1}", 10, i + 1) for i in range(53)])
    seeds = spark.createDataFrame([("c", "X", "a0", 10)], "chain string, asset string, address string, amount long")
    got = {r.address: int(r.held) for r in folds.taint(rows, seeds, ("fifo",)).where("held > 0").collect()}
    assert got == {"a53": 10}


def test_routes_respect_time(spark):
    rows = ledger(spark, [("a", "x", 1, 10), ("x", "b", 1, 5), ("a", "y", 1, 10), ("y", "b", 1, 20)])
    assert [r.path for r in graph.routes(rows, "a", "b").collect()] == ["a>y>b"]


def test_longest_run_and_probe(spark):
    rows = ledger(spark, [("a", "b", x, i) for i, x in enumerate((1, 2, 4, 8, 16, 3))])
    run = sequences.longest_runs(rows).first()
    assert (run.steps, run.start) == (5, 1)
    assert sequences.probes(rows).first().kind == "escalation"


def test_totals_are_exact(spark):
    rows = ledger(spark, [("a", "b", 10**27 + 1, 1), ("a", "b", 10**27 + 1, 2)])
    assert int(store.totals_by_asset(rows).first().total_raw) == 2 * 10**27 + 2


def test_components(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("f", "f")], "a string, b string")
    assert {(r.node, r.component) for r in graph.connected(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}


def test_policy_order_and_floors(spark):
    schema = "address string, exposures array<struct<node:string,hop:int,share:double,category:string,confidence:int,role:string>>, n_signals int, complete boolean"
    one = lambda hop, share, category, role=None, confidence=4: [("n", hop, share, category, confidence, role)]
    rows = [
        ("direct", one(0, 0.1, "sanctioned"), 0, True), ("far", one(2, 0.1, "sanctioned"), 0, True), ("attacker", one(1, 0.1, "service", "attacker"), 0, True), ("mixed", one(0, 0.05, "mixer"), 0, True),
        ("little", one(0, 0.04, "mixer"), 0, True), ("scam", one(3, 0.01, "scam"), 0, True), ("rumour", one(3, 0.01, "illicit", confidence=2), 0, True), ("exchange", one(0, 1.0, "cex"), 0, True),
        ("gap", one(0, 1.0, "cex"), 0, False), ("shape", [], 2, True), ("nothing", [], 0, True),
    ]
    got = {r.address: (r.rule, r.action) for r in risk.decide(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "direct": ("sanctioned-direct", "reject"), "far": ("sanctioned-indirect", "escalate"), "attacker": ("attacker-role", "escalate"), "mixed": ("mixer-material", "enhanced_kyc"), "little": ("default", "hold"),
        "scam": ("illicit-well-sourced", "escalate"), "rumour": ("default", "hold"), "exchange": ("exchange-only", "allow"), "gap": ("incomplete", "hold"), "shape": ("shape-only", "hold"), "nothing": ("default", "hold"),
    }
    with pytest.raises(ValueError, match="max_hop"):
        risk.rule_of({"name": "r", "action": "hold", "max_hop": 1})
    assert risk.rule_of({"name": "r", "action": "hold", "categories": ["cex"]}).categories == ("cex",)


def test_screen_starts_at_hop_zero_and_names_gaps(spark):
    rows = ledger(spark, [("bad", "s", 10, 1), ("far", "bad", 10, 2), ("ex", "t", 7, 3), ("who", "u", 5, 4)])
    claims = spark.createDataFrame([("bad", None, "L", "sanctioned", 4, "x", 1), ("ex", None, "E", "cex", 4, "x", 1)], "address string, chain string, label string, category string, confidence int, source string, observed_at long")
    edges = store.edges(rows, "in")
    chain = rows.first().chain
    subjects = spark.createDataFrame([(chain, a, "X") for a in "stuv"], "chain string, address string, asset string")
    followed = spark.createDataFrame([(chain, a) for a in ("bad", "far", "ex")], "chain string, address string")
    screens = risk.screen(edges, claims, subjects, expanded=followed)
    got = {r.address: ([(x.node, x.hop) for x in r.exposures], r.complete) for r in screens.collect()}
    assert got == {"s": ([("bad", 0)], True), "t": ([("ex", 0)], True), "u": ([], False), "v": ([], True)}
    assert {r.address: r.action for r in risk.decide(screens).collect()} == {"s": "reject", "t": "allow", "u": "hold", "v": "hold"}
    assert {r.address: [(g.node, g.stopped) for g in r.gaps] for r in screens.where("size(gaps) > 0").collect()} == {"u": [("who", "unreachable")]}
    drops = {(r.address, r.kind, r.without): (r.was, r.becomes) for r in risk.counterfactuals(screens).collect()}
    assert drops == {("s", "source", "x"): ("reject", "hold"), ("t", "source", "x"): ("allow", "hold")}


def test_chains_do_not_mix_in_a_screen(spark):
    """One address on two chains: the other chain's history and claims say nothing; a claim without a chain holds on both."""
    rows = ledger(spark, [("bad", "s", 10, 1)]).unionByName(ledger(spark, [("good", "s", 10, 2), ("mix", "s", 10, 3)]).withColumn("chain", F.lit("other:1")))
    here = rows.first().chain
    schema = "address string, chain string, label string, category string, confidence int, source string, observed_at long"
    claims = spark.createDataFrame([("bad", here, "L", "sanctioned", 4, "x", 1), ("good", here, "G", "scam", 4, "x", 1), ("mix", None, "M", "mixer", 4, "y", 1), ("mix", "other:1", "M2", "mixer", 3, "z", 1)], schema)
    subjects = spark.createDataFrame([(here, "s", "X"), ("other:1", "s", "X")], "chain string, address string, asset string")
    got = {r.chain: [(x.node, x.category, x.sources) for x in r.exposures] for r in risk.screen(store.edges(rows, "in"), claims, subjects).collect()}
    assert got == {here: [("bad", "sanctioned", ["x"])], "other:1": [("mix", "mixer", ["y", "z"])]}
    signals = {r.chain: r.n for r in risk.shape_signals(rows).where("address = 's'").collect()}
    assert signals == {here: 1, "other:1": 2}


def test_a_source_counts_only_where_it_stands_alone(spark):
    schema = "chain string, address string, exposures " + f"array<{risk.EXPOSURE}>, signals array<string>, complete boolean, n_signals int"
    one = lambda category, *sources: ("n", 0, 1.0, category, 4, None, list(sources))
    rows = [("c", "both", [one("sanctioned", "a", "b")], [], True, 0), ("c", "alone", [one("sanctioned", "a"), one("mixer", "b")], [], True, 0), ("c", "shape", [], ["probing"], True, 1), ("c", "shapes", [], ["probing", "fresh_address"], True, 2)]
    got = {(r.address, r.kind, r.without, r.was, r.becomes) for r in risk.counterfactuals(spark.createDataFrame(rows, schema), default="allow").collect()}
    assert got == {("alone", "source", "a", "reject", "enhanced_kyc"), ("shape", "signal", "probing", "hold", "allow")}


def test_a_node_counts_at_its_first_reach(spark):
    rows = ledger(spark, [("p", "s", 60, 1), ("q", "s", 40, 2), ("x", "p", 10, 3), ("x", "q", 10, 4), ("y", "p", 30, 5), ("s", "y", 1, 6)])
    got = {r.node: (r.hop, round(r.share, 6), r.stopped) for r in graph.backward_walk(store.edges(rows, "in"), spark.createDataFrame([("s", "X")], "address string, asset string"), hops=2).collect()}
    assert got == {"p": (0, 0.6, None), "q": (0, 0.4, None), "x": (1, 0.15, "hop_limit"), "y": (1, 0.45, "hop_limit")}


@pytest.mark.parametrize("bad", [
    "DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT * FROM parquet.`/x`", "SELECT 'a", "WITH x AS (SELECT 1) -- '\n INSERT INTO t SELECT * FROM x -- '",
    "SELECT 1 -- '\n UNION ALL SELECT * FROM parquet.`/x` -- '", "SELECT * FROM delta.`/x`", "SELECT /* ' */ 1 FROM json.`/x` /* ' */", "SELECT 1 /* open", "SELECT reflect('java.lang.System', 'exit', 0)", "SET a = b", "FROM t INSERT OVERWRITE u SELECT *", r"SELECT r'\' AS a UNION ALL SELECT java_method('java.lang.System', 'getProperty', 'user.home') -- '",
])
def test_guard_refuses(bad):
    with pytest.raises(sql_surface.RefusedSql):
        sql_surface.guard(bad)


@pytest.mark.parametrize("good", ["SELECT add, use, load FROM t", "SELECT `insert into` FROM t", "SELECT 1 -- insert into t", "SELECT 'it''s; drop table t' AS x", "(SELECT 1)", "SELECT /* /* nested */ drop table */ 1"])
def test_guard_allows(good):
    assert sql_surface.guard(good)


def test_sql_runs_and_refuses_what_spark_parses_as_a_command(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sql_surface.sql(spark, "SELECT sum(id) AS s FROM numbers WHERE id IN (SELECT id FROM numbers WHERE id > 0)").first().s == 3
    for bad in ("SELECT * FROM numbers ASOF JOIN numbers b ON numbers.id = b.id", "SELECT `reflect`('java.lang.System', 'currentTimeMillis')", "SELECT 1 WHERE EXISTS (SELECT `java_method`('java.lang.System', 'gc'))", "SELECT * FROM text . `x`"):
        with pytest.raises(sql_surface.RefusedSql):
            sql_surface.sql(spark, bad)
    assert sql_surface.sql_limited(spark, "SELECT id FROM numbers ORDER BY id", 2) == ([(0,), (1,)], True)
    spark.range(2).write.parquet(str(tmp_path / "files"))
    for bad in (f"SELECT * FROM parquet . `{tmp_path}/files`", f"SELECT * FROM `parquet`.`{tmp_path}/files`", "FROM numbers INSERT INTO other SELECT id"):
        with pytest.raises(Exception, match="(?i)refused|files|supported|not found"):
            sql_surface.sql(spark, bad).collect()


def test_guard_allows_words_in_literals():
    assert sql_surface.guard("SELECT 'drop table' AS x -- insert")


def test_amounts_as_text(spark):
    df = spark.sql("SELECT CAST(1234567890123 AS DECIMAL(38,0)) AS a, 6 AS d")
    assert df.select(scalar.human(F.col("a"), F.col("d"))).first()[0] == "1,234,567.890123"


def test_stream_equals_batch(spark, tmp_path):
    rows = ledger(spark, [("a", "b", 10, 1), ("a", "b", 500, 2), ("b", "c", 900, 3)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    fired = watches.fired(stream, [("large", "urgent", F.col("amount_raw") > 100)])
    watches.catch_up(fired, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(int(r.amount_raw) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [500, 900]


# --- running values, pools, as-of


def test_running_values_over_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(40), i, rng.randrange(9) if rng.random() < 0.5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, i long, v long")
    v = F.col("v")
    got = ordered.running_sum(df, ["k"], ["at", "i"], F.coalesce(v, F.lit(0)), "total", width=3)
    got = ordered.running_max_before(got, ["k"], ["at", "i"], v, "most", width=5)
    got = ordered.carried(got, ["k"], ["at", "i"], v, "last", width=4)
    got = ordered.carried_back(got, ["k"], ["at", "i"], v, "next", width=4)
    for r in got.collect():
        before = sorted((x for x in rows if x[0] == r.k and (x[1], x[2]) <= (r["at"], r.i)), key=lambda x: (x[1], x[2]))
        after = sorted((x for x in rows if x[0] == r.k and (x[1], x[2]) >= (r["at"], r.i)), key=lambda x: (x[1], x[2]))
        assert r.total == sum(x[3] or 0 for x in before)
        assert r.most == max((x[3] for x in before[:-1] if x[3] is not None), default=None)
        assert r.last == next((x[3] for x in reversed(before) if x[3] is not None), None)
        assert r.next == next((x[3] for x in after if x[3] is not None), None)


def brute_matches(ins, outs, window, most):
    found = []
    for pool in {x[0] for x in ins}:
        taken = set()
        for _, tx, block, idx, _ in sorted((x for x in ins if x[0] == pool), key=lambda x: (x[2], x[3], x[1])):
            fit = sorted((x for x in outs if x[0] == pool and (x[2], x[3]) > (block, idx) and x[2] - block <= window), key=lambda x: (x[2], x[3], x[1]))
            free = [x for x in fit if x[1] not in taken]
            if free and len(fit) <= most:
                taken.add(free[0][1])
                found.append((pool, tx, free[0][1], len(fit)))
    return sorted(found)


def test_pool_matches_equal_brute_force(spark):
    rng = random.Random(11)
    schema = "pool long, tx string, block long, idx long, address string"
    ins = [(rng.randrange(2), f"d{i}", rng.randrange(9000), 0, "a") for i in range(150)]
    outs = [(rng.randrange(2), f"w{i}", rng.randrange(9000), 0, "a") for i in range(220)]
    d, w = spark.createDataFrame(ins, schema), spark.createDataFrame(outs, schema)
    got = sorted((r.pool, r.deposit, r.withdrawal, r.anonymity_set) for r in clusters.match_withdrawals(d, w, 100, 5).collect())
    assert got == brute_matches(ins, outs, 100, 5) and len(got) > 50
    d, w = (views.pool_events(spark, DIR, kind) for kind in ("purchase", "signup"))
    got = sorted((r.pool, r.deposit, r.withdrawal, r.anonymity_set) for r in clusters.match_withdrawals(d, w).collect())
    assert got == brute_matches([tuple(r) for r in d.collect()], [tuple(r) for r in w.collect()], 100, 5)


# --- holders, tokens, peel chains, graphs


def test_holder_links_by_kind(spark):
    rows = [("a", "b", 5, 1), ("f", "c", 100, 2), ("f", "d", 99, 3), ("c", "e", 7, 4), *[("svc", f"x{i}", 1, 10 + i) for i in range(9)], ("svc", "g", 1, 30), ("svc", "h", 1, 31), ("g", "dep", 3, 40), ("h", "dep", 3, 41), ("dep", "svc", 6, 42)]
    listed = spark.createDataFrame([(x,) for x in "abcdegh"], "address string")
    frame = ledger(spark, rows)
    kinds = {(r.kind, *sorted((r.a, r.b))) for r in holders.holder_links(listed, frame).collect()}
    assert {("direct", "a", "b"), ("shared_funder", "c", "d"), ("batch_funded", "c", "d"), ("direct", "c", "e"), ("funded_by_member", "c", "e"), ("shared_deposit", "g", "h")} <= kinds
    assert not any(k == "shared_funder" and "g" in x for k, *x in kinds)  # a service links nobody
    got = {r.address: (r.holder, r.size) for r in holders.holders(listed, frame).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 3), "d": ("c", 3), "e": ("c", 3), "g": ("g", 2), "h": ("g", 2)}


def test_asset_verdicts(spark):
    usdc = "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48"
    given = [(usdc, "USDC", "genuine"), ("0x1", "USDC", "forged"), (None, "ETH", "genuine"), ("0x2", "ETH", "forged"), ("0x3", "U\u0405DC", "lookalike"), ("0x4", "\u0415\u0422\u041d", "lookalike"), ("0x5", "U\u17b5S\u17b5D\ua4da", "lookalike"), ("0x6", "\u00daSDC", "lookalike"), ("0x7", "B\u0443G", "unknown-script"), ("0x8", "PEPE", "unlisted"), (usdc, "", "unlisted")]
    frame = spark.createDataFrame([("eip155:1", a, s) for a, s, _ in given], "chain string, asset string, symbol string")
    got = {(r.contract, r.symbol): r.verdict for r in tokens.inspected(frame).collect()}
    assert got == {((a or "").lower(), s): v for a, s, v in given}
    assert {r.contract for r in tokens.trusted_assets(frame).collect()} == {"", usdc.lower()}
    more = {("eip155:1", "PEPE"): ["0x9"]}
    assert {r.symbol: r.verdict for r in tokens.inspected(frame.where("symbol = 'PEPE'"), more).collect()} == {"PEPE": "forged"}


def test_lookalike_groups(spark):
    real, fake = "0xa16f5ba4000000000000000000000000000a8968", "0xa16f0de5000000000000000000000000000b8968"
    rows = [("me", real, 5, 1), (fake, "me", 0, 2), ("other", "me", 3, 3)]
    frame = ledger(spark, rows).withColumn("asset", F.lit(None).cast("string"))
    seen = tokens.sightings(frame, tokens.trusted_assets(frame))
    got = [r for r in tokens.lookalikes(seen).collect() if r.address == "me"]
    assert [(r.prefix, r.suffix, r.members, r.decidable, r.meant) for r in got] == [("a16f", "8968", 2, True, real)]
    claimed = frame.withColumn("asset", F.lit("0xbad"))
    seen = tokens.sightings(claimed, tokens.trusted_assets(claimed))
    assert [(r.paid, r.claimed, r.decidable) for r in tokens.lookalikes(seen).where("address = 'me'").collect()] == [(0, 1, False)]


def test_peel_chain_stops(spark):
    out = [(1, 0, "p1", 1000, "x"), (1, 1, "c1", 9001, "y"), (2, 0, "p2", 1000, "x"), (2, 1, "c2", 8001, "y"), (3, 0, "u", 501, "y"), (3, 1, "v", 501, "y")]
    outputs = spark.createDataFrame(out, "txid long, idx int, address string, amount long, script string")
    inputs = spark.createDataFrame([(1, "s"), (2, "c1"), (3, "c2")], "txid long, address string")
    starts = spark.createDataFrame([(1,), (9,)], "txid long")
    got = [(r.start, r.depth, r.txid, r.stopped) for r in peel.peel_chains(starts, inputs, outputs).orderBy("start", "depth").collect()]
    assert got == [(1, 0, 1, None), (1, 1, 2, None), (1, 2, 3, "contested"), (9, 0, 9, "missing")]
    assert [r.stopped for r in peel.peel_chains(starts.where("txid = 1"), inputs, outputs, max_depth=2).orderBy("depth").collect()] == [None, "max_depth"]


def test_nodes_merge_by_confidence(spark):
    rows = [("a", "weak", "cex", 1, False), ("a", "strong", None, 3, True), ("b", None, None, 0, False)]
    got = {r.address: tuple(r)[1:] for r in case_graph.merged_nodes(spark.createDataFrame(rows, "address string, label string, category string, confidence int, expanded boolean")).collect()}
    assert got == {"a": ("strong", "cex", 1, True), "b": (None, None, None, False)}


def test_span_routes_count_what_time_rules_out(spark):
    rows = [("a", "x", 10, 10), ("x", "b", 5, 5), ("a", "y", 10, 10), ("y", "b", 20, 20)]
    got = graph.span_routes(spark.createDataFrame(rows, "source string, target string, first long, last long"), "a", "b").collect()
    assert [(r.path, r.arrival, r.paths, r.impossible) for r in got] == [("a>y>b", 20, 2, 1)]


# --- sources and scalars


def test_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffwallet,name,type,certainty\nW1,"Big, Exchange",Exchange,high\nW2,,mixer,\nW3,x,ofac,7\n', encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"address": "W4", "label": "four", "score": "low"}, "oops"]))
    (tmp_path / "c.json").write_text(json.dumps({"W5": {"label": "five", "category": "bridge"}, "W6": "six"}))
    (tmp_path / "d.jsonl").write_text('{"addr": "W7", "tag": "seven", "network": "eip155:1"}\n\nnot json\n')
    claims = {n: [tuple(r) for r in labels.coerced(label_files.read_labels(spark, str(tmp_path / n)), "s").select("address", "label", "category", "confidence", "problem").collect()] for n in ("a.csv", "b.json", "c.json", "d.jsonl")}
    assert claims["a.csv"] == [("W1", "Big, Exchange", "cex", 3, None), ("W2", None, "mixer", 2, "no label"), ("W3", "x", "sanctioned", 4, "bad confidence")]
    assert ("W4", "four", "unknown", 1, None) in claims["b.json"] and len(claims["b.json"]) == 2
    assert set(claims["c.json"]) == {("W5", "five", "bridge", 2, None), ("W6", "six", "unknown", 2, None)}
    assert ("W7", "seven", "unknown", 2, None) in claims["d.jsonl"] and len(claims["d.jsonl"]) == 2
    with pytest.raises(ValueError, match="xlsx"):
        label_files.read_labels(spark, "f.xlsx")


def test_log_amounts(spark):
    data = ["0x" + format(10**37 + 7, "064x"), "0x" + "f" * 64, "0x", "zz", format(2**64 + 3, "x")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in data], "d string").select(logs.hex_amount(F.col("d"))).collect()]
    assert got == [Decimal(10**37 + 7), None, None, None, Decimal(2**64 + 3)]


def test_hashes_and_encodings(spark):
    one = lambda c, *given: [r[0] for r in spark.createDataFrame([(x,) for x in given], "x string").select(c(F.col("x"))).collect()]
    assert scalar.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    good = "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert one(scalar.checksummed, good.lower(), "0x12", None) == [good, None, None]
    assert one(scalar.valid_checksum, good, good.lower(), good.replace("a", "A", 1)) == [True, True, False]
    tron = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"
    assert one(scalar.hex_of_base58, tron, tron[:-1] + "u") == ["41a614f803b6fd780986a42c78ec9c7f77e6ded13c", None]
    assert one(scalar.base58_of_hex, "0x41a614f803b6fd780986a42c78ec9c7f77e6ded13c") == [tron]
    assert one(scalar.namehash, "", "eth", "a..b") == ["0x" + "0" * 64, "0x93cdeb708b7545dc668eb9280176169d1c33cfd8ed6f04690a0bcc88a93fc4ae", None]
    assert one(scalar.skeleton, "U\u0405DC", "\uff35sdc", "U\u17b5S") == ["USDC", "Usdc", "US"]
    assert one(scalar.memo_text, "aGVsbG8=", "plain text!", "//79") == ["hello", "plain text!", "//79"]
    assert one(scalar.chain_id, "Ethereum", "56", "bip122:abc", "nowhere") == ["eip155:1", "eip155:56", "bip122:abc", None]
    assert one(scalar.coin_type, "0x2::sui::SUI") == ["0x" + "0" * 63 + "2::sui::SUI"]


def test_hashes_of_whole_batches():
    rng = random.Random(1)
    messages = [b"", b"\x00", *(rng.randbytes(n) for n in (1, 134, 135, 136, 137, 271, 272, 273, 1000)), *(rng.randbytes(rng.randrange(400)) for _ in range(40))]
    assert [x.tobytes() for x in scalar.keccak256_of_all(messages)] == [scalar.keccak256(m) for m in messages]
    assert scalar.keccak256_of_all([]).shape == (0, 32)


def test_contracts_made_with_a_salt(spark):
    zero, code = "0x" + "0" * 64, "0xbc36789e7a1e281436464229828f817d6612f7b477d66591ff96a9e064bcc98a"
    rows = [("0x" + "0" * 40, zero, code), ("0xdeadbeef" + "0" * 32, zero, code), ("0x00", zero, code), ("0x" + "0" * 40, "0x1", code)]
    got = spark.createDataFrame(rows, "d string, s string, h string").select(scalar.create2_address(F.col("d"), F.col("s"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["0x4d1a2e2bb4f88f0250f26ffff098b0b30b26bf38", "0xb928f69bb1d91cd65274e3c79d8986362984fda3", None, None]
    salts = spark.createDataFrame(rows[:2], "address string, salt string, code_hash string")
    found = clusters.salted_deployments(salts, salts, spark.createDataFrame([(got[1][0].upper().replace("0X", "0x"),)], "address string")).collect()
    assert [(r.deployer, r.contract) for r in found] == [(rows[1][0], got[1][0])]


def test_bytes_of_a_table(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    assert store.stored_bytes(spark, str(tmp_path / "t")) >= sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))


def test_contracts_of_a_deployer(spark):
    account, made = "0x6ac7ea33f8831ea9dcc53393aaa88b25a785dbf0", ["0xcd234a471b72ba2f1ccf0a70fcaba648a5eecd8d", "0x343c43a37d37dff08ae8c4a11544c718abb4fcf8"]
    contracts = spark.createDataFrame([(x,) for x in [*made, "0x" + "1" * 40]], "address string")
    got = clusters.deployments(spark.createDataFrame([(account,), ("bad",)], "address string"), contracts, 8).collect()
    assert {(r.nonce, r.contract) for r in got} == {(0, made[0]), (1, made[1])}


def test_sources_that_fail_clear_nobody(spark):
    claims = spark.createDataFrame([("a", "L", "sanctioned", 4, "x", 1), ("b", "M", "cex", 3, "x", 1)], "address string, label string, category string, confidence int, source string, observed_at long")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "address string")
    for failed, want in ((True, {"a": (True, False), "b": (None, False), "c": (None, False)}), (False, {"a": (True, False), "b": (False, True), "c": (False, True)})):
        sources = spark.createDataFrame([("x", False), ("y", failed)], "source string, failed boolean")
        assert {r.address: (r.sanctioned, r.cleared) for r in labels.resolved(asked, claims, sources).collect()} == want


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def test_every_oracle_has_rows_somewhere(spark):
    """Queries whose answer on the smallest tables is empty would agree with any other empty answer."""
    for name in ("prd08_unknown_counterparty", "a30_pass_throughs", "r01_decisions"):
        assert catalog.queries()[name](spark, DIR).limit(1).count() == 1


def test_payouts_by_evidence_in_a_calibrated_band(spark):
    cases = spark.createDataFrame([(100.0, 97.0), (200.0, 195.0), (0.0, 1.0)], "expected double, paid double")
    band = asof.calibrated_band(cases)
    assert band == (2.25, 3.25) and asof.calibrated_band(cases.where("expected = 0")) == (0.0, 6.0)
    ins = spark.createDataFrame([("d", 0, 1000.0)], "deposit string, at long, expected double")
    outs = [("far", 400, 990.0, 20_000, 0, 2, False), ("service", 900, 972.0, 20_000, 1, 2, False), ("one-off", 500, 973.0, 2, 50, 3, False), ("change", 600, 972.0, 20_000, 0, 2, True), ("unknown", 700, 972.0, 50, None, 3, False)]
    paid = spark.createDataFrame(outs, "payment string, paid_at long, paid double, payer_txs long, recipient_txs long, outputs int, is_change boolean")
    got = [(r.payment, r.score) for r in asof.ranked_payouts(ins, paid, discount=band).orderBy("rank").collect()]
    assert got == [("service", 11.5), ("unknown", 2.0), ("one-off", -1.0)]
