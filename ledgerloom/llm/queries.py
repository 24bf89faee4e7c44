"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import apportion, byte_cnn, fill_in_middle, ftrl, hash_ring, hyper_min_hash, jaccard_join, latent_search, line_index, quote_links, structure_repair, transport_stream, weak_quality
from .base import bucket_of_id, load


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(transport_stream.text_media(load(spark, sf_dir, "documents")))


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    got = byte_cnn.predict(docs.select("doc_id", "text"), byte_cnn.fit_on(docs))
    return got.select("doc_id", (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(load(spark, sf_dir, "documents"))


def op4_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(load(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.threads(load(spark, sf_dir, "conversations"))


def op7_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.assign(load(spark, sf_dir, "documents"))


def op8_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.dedup_lines(load(spark, sf_dir, "documents"), digest=True)


def op9_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_search.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired_report(load(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(load(spark, sf_dir, "documents"))


def op13_hyper_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_min_hash.near_duplicates(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_transport_stream, op2_byte_cnn, op3_weak_quality, op4_apportion, op5_jaccard_join, op6_quote_links, op7_hash_ring, op8_line_index, op9_ftrl, op10_latent_search, op11_structure_repair, op12_fill_in_middle, op13_hyper_min_hash)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op4_apportion": apportion.SQL, "op8_line_index": line_index.SQL, "op11_structure_repair": structure_repair.SQL, "op12_fill_in_middle": fill_in_middle.SQL}
