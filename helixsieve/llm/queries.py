"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixsieve.llm import exact_dedup, langid, mixing, near_dedup, packing, sharding, substring_dedup, topk, url_reputation, warc
from helixsieve.llm.common import Scratch, table
from helixsieve.llm.oracles import ORACLES


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "langid.lang_pred", "langid.score")


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label under its id: bad if it is toxic or of no quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op4_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages become ARC files, these WARC files, and what is returned is read from them."""
    scratch = Scratch(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), scratch.path("arc"))
    warc.convert_arc(spark, scratch.path("arc"), scratch.path("warc"), scratch=scratch)
    scratch.drop("arc")
    out = warc.read_warc(spark, scratch.path("warc"), scratch=scratch)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("uid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lsh_forest, op3_url_reputation, op4_ball_tree_topk, op5_arc_to_warc, op6_harmonic_packing, op7_exact_dedup, op8_histogram_sort, op9_fair_queueing, op10_suffix_trees)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
