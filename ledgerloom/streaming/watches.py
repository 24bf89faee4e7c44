"""Watches over a stream of transfers, and windowed flows with late data.

The batch function of `operators.labels.evaluate` and the stream apply the same predicates, so a catch-up run with
`availableNow` gives what a batch over the same blocks gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

Watches = list[tuple[str, str, Column]]


def fired(stream: DataFrame, watches: Watches) -> DataFrame:
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(n).alias("watch"), F.lit(s).alias("severity"))) for n, s, test in watches]), lambda x: x.isNotNull())
    keep = ["chain"] if "chain" in stream.columns else []
    return stream.withColumn("e", F.explode(hits)).select("e.watch", "e.severity", *keep, "block", "tx_hash", "log_index", "amount_raw")


def run_once(ledger: DataFrame, watches: Watches, positions: DataFrame, limit: int = 10_000, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, positions after): one round of a runner over all watches. positions: (watch, chain, block) up to which a
    watch has looked; each looks at the blocks behind that up to its chain's newest one. A range with more than `limit`
    events is refused whole: it gives one row of kind `refused` with the number of events, and its position stays, as all
    do in a dry run."""
    newest = ledger.groupBy("chain").agg(F.max("block").alias("until"))
    named = ledger.sparkSession.createDataFrame([(n,) for n, _, _ in watches], "watch string").crossJoin(F.broadcast(newest))  # watches and chains are few
    spans = named.join(positions.select("watch", "chain", F.col("block").alias("since")), ["watch", "chain"], "left").withColumn("since", F.coalesce("since", F.lit(0)))
    hits = fired(ledger, watches).join(F.broadcast(spans), ["watch", "chain"]).where("block > since and block <= until")
    counts = hits.groupBy("watch", "chain").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") > limit)
    events = hits.join(over.select("watch", "chain"), ["watch", "chain"], "left_anti").select("watch", "chain", F.lit("event").alias("kind"), "block", "tx_hash", "log_index", F.lit(1).cast("long").alias("n"))
    refused = over.join(spans, ["watch", "chain"]).select("watch", "chain", F.lit("refused").alias("kind"), F.col("until").alias("block"), F.lit(None).cast("string").alias("tx_hash"), F.lit(None).cast("int").alias("log_index"), "n")
    stays = F.lit(dry_run) | F.col("n").isNotNull()
    after = spans.join(over, ["watch", "chain"], "left").select("watch", "chain", F.when(stays, F.col("since")).otherwise(F.col("until")).alias("block"))
    return events.unionByName(refused), after


EVENT = "watch string, chain string, kind string, block long, tx_hash string, log_index int, n long"


class WatchState(StatefulProcessor):
    """Each transfer fires a watch once, however often and in whatever order its block comes. State of a watch on a chain:
    the newest block at which it fired, and what fired in the `retain` blocks behind that. A transfer from before those is
    `late`: it may have fired and is told, but not as an event. More than `limit` events in one batch are refused whole."""

    def __init__(self, retain: int, limit: int):
        self.retain, self.limit = retain, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", StructType([StructField("block", LongType())]))
        self.fired = handle.getMapState("fired", StructType([StructField("id", StringType())]), StructType([StructField("block", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["block", "tx_hash", "log_index"])
        newest = self.newest.get()[0] if self.newest.exists() else None
        out, batch = [], {}
        for block, tx, index in zip(pdf["block"].tolist(), pdf["tx_hash"].tolist(), pdf["log_index"].tolist(), strict=True):
            name = f"{tx}:{index}"
            if newest is not None and block <= newest - self.retain:
                out.append(("late", block, tx, index, 1))
            elif name not in batch and not (self.fired.exists() and self.fired.containsKey((name,))):
                batch[name] = (block, tx, index)
        if len(batch) > self.limit:
            out.append(("refused", max(b for b, _, _ in batch.values()), None, None, len(batch)))
            batch = {}
        for name, (block, tx, index) in batch.items():
            out.append(("event", block, tx, index, 1))
            self.fired.updateValue((name,), (block,))
        if batch:
            newest = max([newest or 0, *(b for b, _, _ in batch.values())])
            self.newest.update((newest,))
            for old in [k for k, v in self.fired.iterator() if v[0] <= newest - self.retain]:
                self.fired.removeKey(old)
        yield pd.DataFrame([(*key, *x) for x in out], columns=[c.split()[0] for c in EVENT.split(", ")]).astype({"log_index": "Int32"})

    def close(self) -> None:
        pass


def runner(stream: DataFrame, watches: Watches, retain: int = 100_000, limit: int = 10_000) -> DataFrame:
    """Events of watches over a stream of transfers, with the state of `WatchState` per watch and chain (which needs the
    RocksDB state store). The query's checkpoint is the saved position."""
    return fired(stream, watches).groupBy("watch", "chain").transformWithStateInPandas(WatchState(retain, limit), EVENT, "Append", "None")


def deduplicated(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each transfer once, also if its block is replayed within the lateness."""
    return stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["tx_hash", "log_index"])


def windowed_flows(stream: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    keys = [F.window("at", width, slide) if slide else F.window("at", width), F.col("asset")]
    return stream.withWatermark("at", lateness).groupBy(*keys).agg(F.sum("amount_raw").cast("decimal(38,0)").alias("total_raw"), F.count("*").alias("n")).select(F.col("window.start").alias("from_"), "asset", "total_raw", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("at", lateness).groupBy(F.session_window("at", gap), "sender").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("from_"), F.col("session_window.end").alias("to_"), "sender", "n")


def catch_up(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what there is, once and exactly, and stop; the checkpoint is the runner's saved position."""
    return df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
