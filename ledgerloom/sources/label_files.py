"""Label lists as Spark reads them: CSV, JSON and JSON lines, to rows of text columns for `labels.coerced`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import COLUMNS

BAD = "_malformed"


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headers name the columns (a byte order mark is no part of the first one); fields may hold quoted line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; a line that is none stays as a row with the text in `_malformed`."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _texts(lines.select(F.from_json("value", "map<string,string>").alias("m"), F.col("value").alias("raw")))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object whose keys are addresses and whose values are objects or labels. A file is one
    document, so it is one row until it is taken apart."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "array<string>")).alias("raw")).select(F.from_json("raw", "map<string,string>").alias("m"), "raw")
    pairs = whole.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("address", "raw"))
    keyed = F.coalesce(F.from_json("raw", "map<string,string>"), F.create_map(F.lit("label"), F.col("raw")))
    pairs = pairs.select(F.map_zip_with(keyed, F.create_map(F.lit("address"), F.col("address")), lambda k, a, b: F.coalesce(b, a)).alias("m"), "raw")
    return _texts(each.unionByName(pairs))


def _texts(rows: DataFrame) -> DataFrame:
    """(m: map, raw) as columns: the fields that `labels.coerced` knows by any of their headers, whatever else there is."""
    names = sorted({n for known in COLUMNS.values() for n in known})
    entries = F.map_entries("m")
    value = lambda n: F.try_element_at(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), F.lit(1))["value"]
    bad = F.when(F.col("m").isNull() | (F.size("m") == 0), F.col("raw")).alias(BAD)
    return rows.select(*[value(n).alias(n) for n in names], bad)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .csv, .json, .jsonl or .ndjson."""
    readers = {"csv": from_csv, "json": from_json, "jsonl": from_jsonl, "ndjson": from_jsonl}
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}: {', '.join(sorted(readers))}")
    return readers[kind](spark, path)
