"""The plan from text to formatted output, with pluggable providers.

A provider gets prompts in Arrow batches and gives text or a typed error; the offline provider gives
nothing, so that every document takes the fallback. Fallback output is labelled as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sheafwork.functions import text as T
from sheafwork.operators import chunks, cleanup, formatting, postprocess, routing, structure

HIERARCHICAL, SINGLE = "hierarchical_summary", "single_pass_generation"
#: Tokens of a chunk's summary.
CHUNK_BUDGET = 350
#: Prompts in an Arrow batch; the session's own number is lowered to it.
BATCH = 500


class Provider(Protocol):
    name: str

    def generate(self, prompt: str, max_tokens: int) -> dict:
        """{"text": str} or {"error_type": str, "error": str}; or it raises."""


class ProviderError(Exception):
    """A provider's refusal: its HTTP status, where there is one, tells a used-up quota from other errors."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Offline:
    """No model: every prompt fails in the same way."""

    name = "offline"

    def generate(self, prompt: str, max_tokens: int) -> dict:
        return {"error_type": "provider_error", "error": "offline"}


class Extract:
    """A stand-in that answers with the first words of the prompt's last paragraph, one for ten tokens."""

    name = "extract"

    def generate(self, prompt: str, max_tokens: int) -> dict:
        return {"text": " ".join(prompt.rsplit("\n\n", 1)[-1].split()[: max_tokens // 10])}


def outcome(provider: Provider, prompt: str, max_tokens: int) -> dict:
    """One call as {"text"} or one of the five typed errors; an answer without text is one as well."""
    try:
        got = provider.generate(prompt, max_tokens)
    except TimeoutError as e:
        return {"error_type": "timeout", "error": str(e)}
    except ProviderError as e:
        return {"error_type": "quota_exceeded" if e.status == 429 else "provider_error", "error": str(e)}
    except Exception as e:
        return {"error_type": "unexpected_error", "error": str(e)}
    if got.get("error_type") or (got.get("text") or "").strip():
        return got
    return {"error_type": "empty_provider_response", "error": "The provider gave no text"}


def ask(df: DataFrame, provider: type, prompt: str = "prompt", budget: str = "max_tokens", prefix: str = "") -> DataFrame:
    """Adds provider, generated, error_type and error, with ``prefix``. The provider is made once for a Python task.

    A null prompt isn't asked: its row has nulls and no text.
    """
    names = ("provider", "generated", "error_type", "error")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = provider()
        for prompts, budgets in batches:
            asked = prompts.notna()
            got = [outcome(p, t, int(n)) if yes else {} for t, n, yes in zip(prompts, budgets, asked, strict=True)]
            made = [[p.name if yes else None for yes in asked], [g.get("text") or "" for g in got], [g.get("error_type") for g in got], [g.get("error") for g in got]]
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, made, strict=True)})

    # A batch holds few prompts, however many rows a task has.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(batch)) <= BATCH:
        df.sparkSession.conf.set(batch, BATCH)
    # Only prompt and budget go to Python; calls aren't repeated or left out, so the function isn't deterministic to the plan.
    call = F.pandas_udf(run, StructType([StructField(n, StringType()) for n in names])).asNondeterministic()
    d = df.withColumn("_outcome", call(F.col(prompt), F.col(budget)))
    return d.select(*df.columns, *[F.col("_outcome")[n].alias(prefix + n) for n in names])


def answer(df: DataFrame, local: type, hosted: type, prompt: str = "prompt", budget: str = "max_tokens") -> DataFrame:
    """Adds provider, generated, error_type, error, direct and fell_back.

    Large prompts go to the hosted provider directly; others to the local one first, and on where that fails
    or answers poorly. Each provider sees only the prompts that are its own.
    """
    d = df.withColumn("direct", routing.route_large_prompt(F.col(prompt)))
    d = ask(d.withColumn("_ask", F.when(~F.col("direct"), F.col(prompt))), local, "_ask", budget, "_l_")
    failed = F.col("_l_error_type").isNotNull() | routing.low_quality_output(F.col("_l_generated"), F.col(prompt))
    d = d.withColumn("fell_back", ~F.col("direct") & failed)
    d = ask(d.withColumn("_ask", F.when(F.col("direct") | F.col("fell_back"), F.col(prompt))), hosted, "_ask", budget, "_h_")
    names = ("provider", "generated", "error_type", "error")
    one = [F.when(F.col("direct") | F.col("fell_back"), F.col(f"_h_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in names]
    return d.select(*df.columns, *one, "direct", "fell_back")


def first_good(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Of a local and a hosted answer (local_text, hosted_text): hosted for large prompts and poor local answers."""
    large = routing.route_large_prompt(F.col(prompt))
    poor = routing.low_quality_output(F.col("local_text"), F.col(prompt))
    d = df.withColumn("direct", large).withColumn("fell_back", ~large & poor)
    return d.withColumn("generated", F.when(large | poor, F.coalesce(F.nullif(T.strip(F.col("hosted_text")), F.lit("")), F.lit(""))).otherwise(F.col("local_text")))


def prepare(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cleaned and normalized ``final_text`` per document."""
    d = cleanup.cleanup(df, text, "_cleaned").drop("original_length", "cleaned_length", "steps")
    return cleanup.normalize(d, "_cleaned", "final_text").drop("_cleaned")


def merged(selected: DataFrame, local: type, hosted: type, key: str = "doc_id") -> DataFrame:
    """(doc_id, merged, summaries): each chunk summarised, failures skipped, the rest in order under their titles."""
    prompts = selected.select(key, "pick", "title", routing.chunk_prompt(F.col("pick"), F.col("chunk_type"), F.col("title"), F.col("content")).alias("prompt"), F.lit(CHUNK_BUDGET).alias("max_tokens"))
    asked = answer(prompts, local, hosted)
    part = F.concat(F.lit("Chunk "), F.col("pick").cast("string"), F.lit("\nTitle: "), "title", F.lit("\nSummary:\n"), T.strip(F.col("generated")))
    good = F.when(F.col("error_type").isNull() & (T.strip(F.col("generated")) != ""), F.struct("pick", part.alias("t"), T.n_words(F.col("generated")).alias("n")))
    d = asked.groupBy(key).agg(F.array_sort(F.collect_list(good)).alias("p"))
    return d.select(key, T.joined(F.transform("p", lambda x: x["t"]), "\n\n").alias("merged"), F.size("p").alias("summaries"), F.aggregate("p", F.lit(0), lambda n, x: n + x["n"]).alias("summary_words"))


def hierarchical(docs: DataFrame, selected: DataFrame, local: type = Offline, hosted: type = Offline, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, mode, task) with the merge prompt of their chunks' summaries and its answer.

    The merge is asked even where no summary came. ``selected`` has key, pick, chunk_type, title, content
    and limit_applied.
    """
    limited = selected.groupBy(key).agg(F.max("limit_applied").alias("limit_applied"), F.count(F.lit(1)).alias("chunks"))
    d = docs.join(limited, key, "left").join(merged(selected, local, hosted, key), key, "left")
    d = d.withColumn("merged", F.coalesce("merged", F.lit(""))).withColumn("summaries", F.coalesce("summaries", F.lit(0)))
    d = d.withColumn("prompt", routing.merge_prompt(F.col("mode"), F.col("task"), F.coalesce("chunks", F.lit(0)), F.coalesce("limit_applied", F.lit(False)), F.col("merged")))
    d = d.withColumn("max_tokens", routing.token_budget(F.col("task"), F.coalesce("summary_words", F.lit(0)), F.lit(HIERARCHICAL)))
    return answer(d, local, hosted).drop("limit_applied", "summary_words")


def finish(df: DataFrame, text: str = "final_text", mode: str = "mode", task: str = "task") -> DataFrame:
    """What follows an answer (generated, error_type): the fallback where it failed, post-processing, formatting."""
    failed = F.col("error_type").isNotNull() | (T.strip(F.col("generated")) == "")
    d = df.withColumn("_r", F.when(failed, routing.fallback_output(F.col(text), F.col(mode), F.col(task))).otherwise(F.col("generated")))
    d = postprocess.postprocess(d, "_r", "_answer").drop("_r", "original_length", "final_length", "steps")
    return formatting.format_output(d, "_answer", task, text).drop("_answer")


def single_pass(df: DataFrame, local: type = Offline, hosted: type = Offline, text: str = "final_text", mode: str = "mode", task: str = "task") -> DataFrame:
    """Compact prompt, answer, fallback, post-processing and formatting of prepared texts."""
    budget = routing.token_budget(F.col(task), T.n_words(F.col(text)), F.lit(SINGLE))
    d = df.withColumn("prompt", routing.compact(F.col(mode), F.col(task), F.col(text))).withColumn("max_tokens", budget)
    return finish(answer(d, local, hosted), text, mode, task).drop("prompt", "max_tokens")


def generate_offline(df: DataFrame, text: str = "text", mode: str = "mode", task: str = "task", key: str = "doc_id") -> DataFrame:
    """The whole path where no provider answers: prepared text, fallback, post-processing, formatting."""
    d = prepare(df, text, key).withColumn("generated", F.lit("")).withColumn("error_type", F.lit("provider_error"))
    d = finish(d, "final_text", mode, task).drop("generated", "error_type")
    n = T.n_words(F.col("final_text"))
    return d.withColumn("generation_strategy", chunks.plan_strategy(F.lit(1), n)).withColumn("provider", F.lit("offline"))


def parsed_chunks(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Parsed documents with their chunks."""
    return chunks.priority_union(structure.parse(df, text, key), key)
