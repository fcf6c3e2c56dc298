"""File sources and sinks: text, binary files by kind, pluggable OCR engines, JSON and usage sinks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.operators.understand import file_kind

UPLOAD_LIMIT = 15 * 1024 * 1024


class Engine(Protocol):
    """What reads a file's bytes: made once for a Python worker, never for a row."""

    def read(self, content: bytes) -> list[dict]:
        """Rows with page, text and confidence."""


class Nothing:
    """The engine of tests and of machines without OCR: reads no text, deterministically."""

    def read(self, content: bytes) -> list[dict]:
        return [{"page": 1, "text": "", "confidence": 0.0}]


class PlainBytes:
    """Takes the bytes as UTF-8 text; form feeds part pages."""

    def read(self, content: bytes) -> list[dict]:
        return [{"page": k + 1, "text": t, "confidence": 1.0} for k, t in enumerate(content.decode("utf-8", "replace").split("\f"))]


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content, status) of the files under a path; too large ones have no content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = (F.col("length") <= UPLOAD_LIMIT) & (F.col("kind") != "unsupported")
    d = d.withColumn("kind", file_kind(F.col("path")))
    status = F.when(F.col("kind") == "unsupported", "unsupported").when(F.col("length") > UPLOAD_LIMIT, "too_large").otherwise("ok")
    return d.select("path", "kind", "length", F.when(fits, F.col("content")).alias("content"), status.alias("status"))


def read_pages(files: DataFrame, engines: dict[str, type]) -> DataFrame:
    """(path, page, text, confidence, engine, error) by each file's kind; an engine's failure is a row, not the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Engine | None] = {}
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                if kind not in made:
                    try:
                        made[kind] = engines[kind]() if kind in engines else None
                    except Exception:  # an engine that can't start is absent
                        made[kind] = None
                engine, error, pages = made[kind], None, []
                if engine is None:
                    error = "unavailable"
                elif content is not None:
                    try:
                        pages = engine.read(bytes(content))
                    except Exception as e:
                        error = type(e).__name__
                rows += [(path, p["page"], p["text"], float(p["confidence"]), kind, None) for p in pages] or [(path, 0, "", 0.0, kind, error)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "confidence", "engine", "error"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, page int, text string, confidence double, engine string, error string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_usage(spark: SparkSession, path: str, counts: DataFrame) -> None:
    """Adds (key, user_id, day, count, limit) to the usage table at ``path``, a partition a day.

    Days are rewritten whole from a written copy, so that a run that is repeated after a failure reads
    what stood before it.
    """
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    new = counts.select("key", "user_id", "count", "limit", "day")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        old = spark.read.schema(new.schema).parquet(path).join(new.select("day").distinct(), "day", "left_semi").select(new.columns)
        both = old.unionByName(new).groupBy("key", "user_id", "day").agg(F.max("limit").alias("limit"), F.sum("count").alias("n"))
        new = both.select("key", "user_id", F.least("n", "limit").cast(new.schema["count"].dataType).alias("count"), "limit", "day")
        new.write.mode("overwrite").parquet(f"{path}.next")
        new = spark.read.parquet(f"{path}.next")
    new.write.mode("overwrite").partitionBy("day").parquet(path)
