"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import embeddings, html, language, lines, minhash, mixing, packing, quality, secrets
from sheafwork.llm.common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_read(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.top_k(_read(spark, sf_dir, "embeddings"), Scratch(spark, "topk"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_read(spark, sf_dir, "documents"), Scratch(spark, "language"))


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), Scratch(spark, "pack"), tokenizer_path())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark, "minhash"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.line_dedup(docs, Scratch(spark, "lines"))
    return out.selectExpr("doc_id", "_n_lines AS n_lines", "_n_removed AS n_removed", "text")


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_embedding_dedup, op3_quality_classifier, op4_topk_search, op5_mix_sources, op6_language_id, op7_pack, op8_secret_scan, op9_minhash_dedup, op10_line_dedup)}
ORACLES = {"op2_embedding_dedup": embeddings.DEDUP_ORACLE, "op4_topk_search": embeddings.TOPK_ORACLE, "op9_minhash_dedup": minhash.ORACLE, "op5_mix_sources": mixing.ORACLE, "op10_line_dedup": lines.ORACLE, "op8_secret_scan": secrets.ORACLE}
