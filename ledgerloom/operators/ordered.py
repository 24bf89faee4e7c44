"""Running values along an order, in two steps: inside buckets of the order, then over what the buckets carry on. So a key
that holds a third of all rows is spread over as many tasks as it has buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of the order's first column (seconds, minutes, blocks) in a bucket.
WIDTH = 4096


def _joined(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = blocks.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_k").alias("_key_bucket"), "_carried")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_k") == F.col("_key_bucket")]
    return rows.join(named.where("_carried is not null"), same, "left").drop(*[f"_key_{k}" for k in keys], "_key_bucket")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], reading: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the latest non-null `reading` at or before each of them in ascending `order`. The order's first column is
    numeric and not null."""
    return _carry(rows, keys, [F.col(c).asc() for c in order], order, F.max_by, F.col("_k").asc(), reading, name, width)


def carried_back(rows: DataFrame, keys: Sequence[str], order: Sequence[str], reading: Column, name: str, width: int = WIDTH) -> DataFrame:
    """`carried` from the other end: the next reading at or after each row in `order`."""
    return _carry(rows, keys, [F.col(c).desc() for c in order], order, F.min_by, F.col("_k").desc(), reading, name, width)


def _carry(rows: DataFrame, keys: Sequence[str], sort: list[Column], order: Sequence[str], pick: Callable, buckets: Column, reading: Column, name: str, width: int) -> DataFrame:
    marked = rows.withColumns({"_k": F.floor(F.col(order[0]) / width), "_v": reading})
    last = pick("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_v")
    across = Window.partitionBy(*keys).orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*keys, "_k").agg(last).withColumn("_carried", F.last("_v", ignorenulls=True).over(across))
    inside = Window.partitionBy(*keys, "_k").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("_v", F.last("_v", ignorenulls=True).over(inside))
    return _joined(own, blocks, keys).withColumn(name, F.coalesce("_v", "_carried")).drop("_k", "_v", "_carried")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the sum of `value` up to and with each of them in `order`."""
    return _running(rows, keys, order, value, name, width, F.sum, lambda near, far: near + F.coalesce(far, F.lit(0)), 0)


def running_max_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the largest `value` before each of them in `order`; null for a key's first row."""
    return _running(rows, keys, order, value, name, width, F.max, F.greatest, -1)


def _running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int, fold: Callable, both: Callable, end: int) -> DataFrame:
    marked = rows.withColumns({"_k": F.floor(F.col(order[0]) / width), "_v": value})
    across = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*keys, "_k").agg(fold("_v").alias("_v")).withColumn("_carried", fold("_v").over(across))
    inside = Window.partitionBy(*keys, "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    own = marked.withColumn("_v", fold("_v").over(inside))
    return _joined(own, blocks, keys).withColumn(name, both(F.col("_v"), F.col("_carried"))).drop("_k", "_v", "_carried")
