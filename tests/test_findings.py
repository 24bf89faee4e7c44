"""What reviews of the ledger's queries found, each on the least rows that show it."""

import datetime

from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import scalar
from ledgerloom.operators import clusters, folds, graph, tokens
from ledgerloom.plans import session
from ledgerloom.sources import logs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, rows):
    """rows: (event_id, user, type, value, k), written as the events of a folder."""
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, at + datetime.timedelta(seconds=i), u, t, float(v), f'{{"k": {k}}}') for i, u, t, v, k in rows], EVENTS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_forged_transfer_stays_part_of_its_run(spark, tmp_path):
    """r02_shape_signals: five rising payments of one asset are a probe, also where the third of them (block 50) is forged."""
    d = events(spark, tmp_path, [(48 + n, 1, "error", 2 ** n, 2) for n in range(5)])
    got = {r.address: (r.n, r.probing, r.impersonation) for r in catalog.queries()["r02_shape_signals"](spark, d).collect()}
    assert got == {"u1": (5, True, True), "u2": (5, True, True)}


def test_a_walk_goes_through_an_address_of_many_peers(spark, tmp_path):
    """g10_backward_walk: 121 peers are no service there (160 are), so what lies behind is reached; the SQL says the same."""
    d = events(spark, tmp_path, [(0, 2, "purchase", 5, 1)] + [(1 + n, 1000 + n, "purchase", 1, 2) for n in range(120)])
    got = catalog.queries()["g10_backward_walk"](spark, d)
    behind = got.where("root = 'u1' and node <> 'u2'").groupBy("hop", "stopped").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in behind] == [(1, None, 120)]
    assert "HAVING count(*) >= 160" in catalog.oracle_sql()["g10_backward_walk"]


def test_a_small_table_of_dear_rows_is_spread(spark, tmp_path):
    """s05_checksums: one small file isn't one task; g11_deployments: nor are few deployers, also under adaptive execution."""
    spark.range(400).selectExpr("id as c_custkey", "concat('c', id) as c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["s05_checksums"](spark, str(tmp_path))
    assert got.where("valid").select(F.spark_partition_id()).distinct().count() == 4
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        deployers = spark.range(400).select(F.format_string("0x%040x", "id").alias("address"))
        contracts = deployers.select(scalar.created_address(F.col("address"), F.lit(129)).alias("address"))
        got = clusters.deployments(deployers, contracts, 140)
        assert {(r.deployer, r.nonce) for r in got.collect()} == {(f"0x{i:040x}", 129) for i in range(400)}
        tried = clusters.spread(deployers.distinct(), "address")
        assert tried.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")


def test_folds_keep_no_lot_for_each_clean_payment(spark):
    """f01_taint, st03_agreement: clean receipts of a hub are one lot, and payments come in batches, not as one table."""
    fold = folds._Fold({"thief": 5}, "haircut")
    fold.take([(f"u{n}", "hub", 7) for n in range(1000)] + [("thief", "hub", 5), ("hub", "out", 3500)])
    assert len(fold.held_by["hub"].sizes) == 2
    assert fold.result() == folds.fold_taint([(f"u{n}", "hub", 7) for n in range(1000)] + [("thief", "hub", 5), ("hub", "out", 3500)], {"thief": 5}, "haircut")
    rows = [("c", a, f"tx{n}", 0, f"n{n * 7 % 5}", f"n{n * 3 % 4}", n % 9 + 1, n) for n in range(40) for a in ("x", "y")]
    ledger = spark.createDataFrame(rows, "chain string, asset string, tx_hash string, log_index int, sender string, recipient string, amount_raw long, block long")
    seeds = spark.createDataFrame([("c", "x", "n0", 20), ("c", "y", "n1", None)], "chain string, asset string, address string, amount long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.asset, r.address): (int(r.held), int(r.touched), int(r.unresolved)) for r in folds.taint(ledger, seeds, ("haircut",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for asset, given in (("x", {"n0": 20}), ("y", {"n1": None})):
        each = [(r[4], r[5], r[6]) for r in rows if r[1] == asset]
        want |= {(asset, k): v for k, v in folds.fold_taint(each, given, "haircut").items() if v[0] or v[1]}
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sightings_deal_no_contract_to_one_task(spark):
    """a25_sightings: transfers meet trusted contracts by broadcast, not by a shuffle on the contract; both directions count."""
    rows = [("c", "a", "b", None, 5, 1), ("c", "b", "a", "0xbad", 0, 2), ("c", "b", "a", None, 3, 4), ("c", "a", "a", None, 1, 9), ("c", None, "a", None, 1, 9)]
    ledger = spark.createDataFrame(rows, "chain string, sender string, recipient string, asset string, amount_raw long, ts long")
    trusted = spark.createDataFrame([("c", "")], "chain string, contract string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tokens.sightings(ledger, trusted)
        assert {tuple(r) for r in got.collect()} == {("a", "b", 1, 0, 2, 1, 3, 1, 4), ("b", "a", 1, 1, 1, 1, 3, 1, 4)}
        assert "SortMergeJoin" not in plan_of(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paired_changes_stay_inside_transactions(spark):
    """src22_paired_changes: changes and subjects are dealt by transaction, and nothing is dealt again; a transaction's two
    subjects have a net change each."""
    rows = [(1, 0, "s", "X", 5), (1, 1, "s", "X", 3), (1, 2, "t", "X", -4), (1, 9, "c", "X", -8), (2, 0, "s", "A", 6), (2, 1, "t", "A", 0), (2, 9, "c", "A", -8), (2, 9, "d", "A", 7)]
    changes = spark.createDataFrame(rows, "tx long, position long, owner string, coin string, amount long")
    subjects = spark.createDataFrame([(1, "c", 1), (2, "c", 2), (2, "d", 1)], "tx long, subject string, gas long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = logs.paired_changes(changes, subjects, "A")
        found = {(r.tx, r.sender, r.recipient, r.amount_raw, r.kind) for r in got.collect()}
        assert found == {(1, "c", "s", 5, "token"), (2, "c", "s", 6, "native"), (2, "c", "d", 7, "native"), (2, "c", "d", 8, "native")}
        assert plan_of(got).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_change_scores_deal_outputs_by_transaction_once(spark):
    """st05_peel_chains, g08_change_scores: one shuffle by transaction, and one of what is left of addresses."""
    outputs = spark.createDataFrame([(1, 0, "a", 5, "x"), (1, 1, "b", 9, "x"), (2, 0, "b", 7, "y"), (2, 1, None, 7, None)], "txid long, idx int, address string, amount long, script string")
    inputs = spark.createDataFrame([(1, "b"), (1, "b"), (2, None)], "txid long, address string")
    got = graph.change_scores(inputs, outputs)
    assert {(r.txid, r.idx, r.score, r.is_change) for r in got.collect()} == {(1, 0, 1, False), (1, 1, 9, True), (2, 0, 2, True), (2, 1, 0, False)}
    assert plan_of(got).count("Exchange hashpartitioning") == 2
    seen = spark.createDataFrame([("a", 4), ("b", 1)], "address string, seen long")
    assert {(r.txid, r.idx, r.score) for r in graph.change_scores(inputs, outputs, seen).collect()} == {(1, 0, 2), (1, 1, 8), (2, 0, 1), (2, 1, 0)}


def test_a_sweep_gives_back_native_memory(spark, monkeypatch):
    """The pipeline and op10 were stopped for the driver's memory, a third of it freed by the JVM and kept by the C library."""
    said = []
    monkeypatch.setattr(session, "trim", lambda s, f=session.trim: said.append(f(s)))
    monkeypatch.setattr(session, "_swept", [-1e9])
    session.release(session.cut(spark.range(3)))
    assert len(said) == 1 and (not said[0] or "native heap" in said[0])


def test_a_batch_deals_a_funded_address_to_two_buckets(spark):
    rows = [(f"a{i * 7 % 40:02}", f"f{i % 2}", b, 100 + i % 3 * 8) for i, b in enumerate([*range(0, 60, 3), 24, 25, 49, 50, 50, 51, -1, -26])]
    got = clusters.batch_funded(spark.createDataFrame(rows, "address string, funder string, block long, amount_raw long"))
    wanted = {(f, a, b) for a, f, p, x in rows for b, g, q, y in rows if a < b and f == g and abs(p - q) <= 25 and min(x, y) >= 0.9 * max(x, y)}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    assert "+ 1)" not in plan_of(got)
