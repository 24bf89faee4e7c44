"""As-of joins without nested loops: both sides are laid in one order and the latest (or next) reading is carried."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import WIDTH, carried, carried_back


def _laid_out(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> tuple[DataFrame, Column]:
    """Both sides' rows, readings before rows at the same moment, and what a reading is."""
    a = left.withColumns({"_left": F.lit(1), "_r": F.lit(None).cast(right.schema[value].dataType)})
    b = right.where(F.col(at).isNotNull()).select(key, at, F.col(value).alias("_r"), F.lit(0).alias("_left"))
    return a.unionByName(b, allowMissingColumns=True), F.when(F.col("_left") == 0, F.struct(F.col(at).alias("at"), F.col("_r").alias("v")))


def backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """left with the value of right's latest row of the same key at or before `at`, and its time. Readings are carried
    along buckets of time, so a key is not one task."""
    both, reading = _laid_out(left, right, key, at, value)
    got = carried(both, [key], [at, "_left"], reading, "_s", width).where("_left = 1")
    return got.select(*left.columns, F.col("_s.v").alias(name), F.col("_s.at").alias(f"{name}_at"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str, within: int, width: int = WIDTH) -> DataFrame:
    """left with the nearest reading of the same key within a distance (the earlier one at a tie), and the distance. Rows
    without a moment or key have no reading."""
    both, reading = _laid_out(left, right, key, at, value)
    # at the same moment readings come after rows here, so that the next one includes them
    both = carried(both, [key], [at, "_left"], reading, "_p", width).withColumn("_late", 1 - F.col("_left"))
    both = carried_back(both, [key], [at, "_late"], reading, "_n", width)
    back, ahead = F.col(at) - F.col("_p.at"), F.col("_n.at") - F.col(at)
    pick = F.when(F.col("_n").isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    got = both.where("_left = 1").withColumn("_s", pick).withColumn("_g", F.abs(F.col(at) - F.col("_s.at")))
    near = F.col("_g") <= within
    return got.select(*left.columns, F.when(near, F.col("_s.v")).alias(name), F.when(near, F.col("_g")).alias(f"{name}_gap"))


def block_at(ledger: DataFrame, moments: DataFrame) -> DataFrame:
    """The last block at or before each moment; null before the first block."""
    blocks = ledger.select("chain", "ts", "block")
    return backward(moments, blocks.groupBy("chain", "ts").agg(F.max("block").alias("block")), "chain", "ts", "block", "found")


def valued(ledger: DataFrame, klines: DataFrame, quote: str = "USDT", max_gap: int = 15, within: int = 120) -> DataFrame:
    """Each transfer at the rate of its own minute, or a reason why it has no value; so totals are floors."""
    rows = ledger.withColumn("symbol_pair", F.concat("symbol", F.lit(quote))).withColumn("minute_no", F.floor(F.col("ts") / 60))
    rates = klines.withColumnRenamed("symbol", "symbol_pair")
    got = nearest(rows, rates, "symbol_pair", "minute_no", "close_px", "rate", within)
    reason = F.when(F.col("ts").isNull(), "no time").when(F.col("symbol").isNull(), "no symbol").when(F.col("rate").isNull(), "no rate").when(F.col("rate_gap") > max_gap, "rate too far")
    value = (F.col("amount_raw").cast("decimal(18,0)") * F.col("rate")).cast("decimal(38,4)")
    return got.withColumn("refused", reason).select("tx_hash", "symbol", "amount_raw", "rate", "rate_gap", "refused", F.when(reason.isNull(), value).alias("value_raw"))


def rate_coverage(klines: DataFrame) -> DataFrame:
    return klines.groupBy("symbol").agg(F.count("*").alias("minutes"), F.min("minute_no").alias("first_minute"), F.max("minute_no").alias("last_minute"))


def cross_rate(klines: DataFrame, base: str, quote: str, via: str = "USDT") -> DataFrame:
    """Per minute: base in quote through a common third unit, with how it was derived."""
    a = klines.where(F.col("symbol") == base + via).select("minute_no", F.col("close_px").alias("b"))
    b = klines.where(F.col("symbol") == quote + via).select("minute_no", F.col("close_px").alias("q"))
    return a.join(b, "minute_no").select("minute_no", (F.col("b").cast("decimal(20,8)") / F.col("q").cast("decimal(20,8)")).cast("decimal(30,8)").alias("rate"), F.lit(f"via {via}").alias("derivation"))


def calibration(cases: DataFrame) -> DataFrame:
    """Discount of payouts against what was expected, in percent: mean, spread, cases, whether it is consistent."""
    pct = (F.col("expected") - F.col("paid")) * 100.0 / F.col("expected")
    used = cases.where("expected <> 0").withColumn("pct", pct)
    return used.groupBy("source").agg(F.round(F.avg("pct"), 6).alias("mean_pct"), F.round(F.max("pct") - F.min("pct"), 6).alias("spread_pct"), F.count("*").alias("n"), (F.max("pct") - F.min("pct") < 0.2).alias("consistent"))


def payouts(deposits: DataFrame, payments: DataFrame, window: tuple[int, int] = (300, 2700), discount: tuple[float, float] = (0.0, 6.0)) -> DataFrame:
    """Payments that can answer a deposit: in a time band after it and in a discount band below the expected amount.
    Time is bucketed by the band's length and amounts by the band's ratio (logarithms), so each deposit meets the
    payments of two buckets of time and about two of amounts instead of all payments."""
    span = window[1]
    low, high = F.col("expected") * (1 - discount[1] / 100), F.col("expected") * (1 - discount[0] / 100)
    step = max(1e-6, math.log((1 - discount[0] / 100) / max(1e-9, 1 - discount[1] / 100)))
    d = deposits.where("expected > 0").withColumn("_b", F.explode(F.array(F.floor((F.col("at") + window[0]) / span), F.floor((F.col("at") + window[0]) / span) + 1)))
    # a bucket's edge may lie on either side of a rounded logarithm, so the range is a little wider than the band
    d = d.withColumn("_a", F.explode(F.sequence(F.floor(F.ln(low) / step - 1e-6), F.floor(F.ln(high) / step + 1e-6))))
    p = payments.where("paid > 0").withColumns({"_b": F.floor(F.col("paid_at") / span), "_a": F.floor(F.ln("paid") / step)})
    got = d.join(p, ["_b", "_a"]).where((F.col("paid_at") >= F.col("at") + window[0]) & (F.col("paid_at") <= F.col("at") + window[1]))
    return got.where((F.col("paid") >= low) & (F.col("paid") <= high)).drop("_b", "_a")


def payout_score(payer_txs: Column, recipient_txs: Column, outputs: Column, discount_pct: Column) -> Column:
    """Evidence for one payment, by fixed weights."""
    one = F.when(payer_txs >= 10000, 5.0).when(payer_txs.between(0, 3), -3.0).otherwise(0.0)
    return one + F.when(recipient_txs.between(0, 2), 3.0).otherwise(0.0) + F.when(outputs == 2, 1.5).otherwise(0.0) + F.when(discount_pct.between(0, 5), 2.0).otherwise(0.0)


def calibrated_band(cases: DataFrame, tolerance: float = 0.5) -> tuple[float, float]:
    """The band of discounts, in percent, to search for a service's payouts: its mean over known cases (expected, paid),
    which are one row here, and a tolerance on both sides."""
    mean = cases.where("expected <> 0").agg(F.avg((F.col("expected") - F.col("paid")) * 100.0 / F.col("expected"))).first()[0]
    return (0.0, 6.0) if mean is None else (mean - tolerance, mean + tolerance)


def ranked_payouts(deposits: DataFrame, payments: DataFrame, top: int = 5, **band: tuple) -> DataFrame:
    """The best payouts of each deposit, by evidence. payments also have payer_txs, recipient_txs (null: unknown), outputs
    and is_change: what is change pays nobody. Equal evidence: the earlier payment, then its name."""
    found = payouts(deposits, payments.where("not is_change"), **band)
    pct = (F.col("expected") - F.col("paid")) * 100.0 / F.col("expected")
    found = found.withColumns({"discount_pct": pct, "score": payout_score(F.col("payer_txs"), F.col("recipient_txs"), F.col("outputs"), pct)})
    order = Window.partitionBy("deposit").orderBy(F.desc("score"), "paid_at", "payment")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("deposit", "payment", "rank", "score", F.round("discount_pct", 6).alias("discount_pct"))
