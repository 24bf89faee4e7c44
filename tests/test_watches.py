"""The watch runner: a batch round by positions, and the same over a stream with replayed and late blocks."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.streaming import watches

ROWS = "chain string, tx_hash string, log_index int, block long, amount_raw decimal(38,0), symbol string"


def named():
    return [("large", "urgent", F.col("amount_raw") >= 50), ("small", "info", F.col("amount_raw") < 10)]


def rows(*blocks):
    return [("c", f"t{b}", 0, b, Decimal(b % 100), "X") for b in blocks]


def test_a_round_moves_positions(spark):
    ledger = spark.createDataFrame(rows(1, 5, 60, 70, 105) + [("d", "u8", 0, 8, Decimal(8), "X")], ROWS)
    at = spark.createDataFrame([("large", "c", 60)], "watch string, chain string, block long")
    events, after = watches.run_once(ledger, named(), at)
    assert {(r.watch, r.chain, r.block) for r in events.collect()} == {("large", "c", 70), ("small", "c", 1), ("small", "c", 5), ("small", "c", 105), ("small", "d", 8)}
    assert {tuple(r) for r in after.collect()} == {("large", "c", 105), ("small", "c", 105), ("large", "d", 8), ("small", "d", 8)}
    again, _ = watches.run_once(ledger, named(), after)
    assert again.collect() == []
    _, dry = watches.run_once(ledger, named(), at, dry_run=True)
    assert {tuple(r) for r in dry.collect()} == {("large", "c", 60), ("small", "c", 0), ("large", "d", 0), ("small", "d", 0)}


def test_a_range_past_the_limit_is_refused_whole(spark):
    ledger = spark.createDataFrame(rows(1, 5, 60, 105), ROWS)
    events, after = watches.run_once(ledger, named(), spark.createDataFrame([], "watch string, chain string, block long"), limit=2)
    assert {(r.watch, r.kind, r.block, r.n) for r in events.collect()} == {("large", "event", 60, 1), ("small", "refused", 105, 3)}
    assert {tuple(r) for r in after.collect()} == {("large", "c", 105), ("small", "c", 0)}


def test_replayed_and_late_blocks_fire_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def batch(*blocks):
            spark.createDataFrame(rows(*blocks), ROWS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(ROWS).parquet(source)
            watches.catch_up(watches.runner(stream, named(), retain=500, limit=4), sink, state).awaitTermination()
            return sorted((r.watch, r.kind, r.block, r.n) for r in spark.read.parquet(sink).collect())

        assert batch(1, 60, 70, 205) == [("large", "event", 60, 1), ("large", "event", 70, 1), ("small", "event", 1, 1), ("small", "event", 205, 1)]
        got = batch(70, 65, 205, 3, 3)  # two replayed, two late, one of them twice
        assert got == [("large", "event", 60, 1), ("large", "event", 65, 1), ("large", "event", 70, 1), ("small", "event", 1, 1), ("small", "event", 3, 1), ("small", "event", 205, 1)]
        ledger = spark.createDataFrame(rows(1, 60, 70, 205, 65, 3), ROWS)
        events, _ = watches.run_once(ledger, named(), spark.createDataFrame([], "watch string, chain string, block long"))
        assert sorted((r.watch, r.kind, r.block, r.n) for r in events.collect()) == got
        more = [x for x in batch(901, 902, 903, 904, 905, 1060, 2) if x not in got]
        assert more == [("large", "event", 1060, 1), ("small", "refused", 905, 6)]  # 2 isn't late yet: nothing new has fired
        assert [x for x in batch(1001, 4) if x not in got + more] == [("small", "event", 4, 1), ("small", "event", 1001, 1)]
        assert ("small", "late", 6, 1) in batch(6)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_sessions_and_repeats(spark, tmp_path):
    rows = [("t1", 0, "a", "X", 5, "2024-01-01 00:10:00"), ("t1", 0, "a", "X", 5, "2024-01-01 00:10:00"), ("t2", 0, "a", "X", 7, "2024-01-01 00:50:00"), ("t3", 1, "b", "X", 1, "2024-01-01 00:59:00"), ("t4", 0, "a", "Y", 2, "2024-01-01 03:00:00")]
    given = spark.createDataFrame(rows, "tx_hash string, log_index int, sender string, asset string, amount_raw long, at string").withColumn("at", F.to_timestamp("at"))
    given.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    watches.catch_up(watches.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    once = spark.read.parquet(str(tmp_path / "out"))
    assert once.count() == 4
    flows = {(r.from_.hour, r.asset): (int(r.total_raw), r.n) for r in watches.windowed_flows(once).collect()}
    assert flows == {(0, "X"): (13, 3), (3, "Y"): (2, 1)}
    sat = sorted((r.sender, r.from_.hour, r.from_.minute, r.n) for r in watches.sessions(once, "45 minutes").collect())
    assert sat == [("a", 0, 10, 2), ("a", 3, 0, 1), ("b", 0, 59, 1)]
