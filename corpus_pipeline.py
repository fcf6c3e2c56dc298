"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.llm import language, lines, minhash, mixing, packing
from sheafwork.llm.common import Scratch, unwrapped, wrapped
from sheafwork.llm.queries import tokenizer_path

#: A document whose language is less certain than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier names with some certainty; their columns are unchanged.

    Where no row can be learned from, there is nothing to judge by: all texts with a letter stay.
    """
    model = language.fit(docs, Scratch(spark, "language"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = language.identify(wrapped(docs, "text"), model)
    return unwrapped(named.where((F.col("_lang_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; n_chars follows the text. A text that was repeated whole goes."""
    out = lines.line_dedup(wrapped(docs, "doc_id", "text"), Scratch(spark, "lines"))
    out = out.where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]).cast("long")
    return unwrapped(out, docs.columns, text=F.col("text"), n_chars=n_chars)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id (of several rows of it, one)."""
    kept = minhash.near_duplicates(docs, Scratch(spark, "minhash")).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("row"))
    rows = wrapped(docs, "doc_id")
    named = rows.where("doc_id is not null").join(kept.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return unwrapped(named.select("row").unionByName(rows.where("doc_id is null").select("row")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, Scratch(spark, "pack"), tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can't express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
