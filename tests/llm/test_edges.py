"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheafwork.llm import embeddings, html, language, lines, minhash, mixing, packing, quality, secrets
from sheafwork.llm.common import Scratch
from sheafwork.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 10),
    (2, None, "en", None, 0),
    (3, "", None, "a", 0),
    (4, "123 456 !!", "de", "b", 9),
    (5, LONG, "en", "a", len(LONG)),
    (6, "ein kurzer text", "de", None, 15),
    (6, "ein kurzer text", "de", None, 15),
    (None, "no id here at all", "en", "b", 17),
    (8, "   \n\n ", "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that the operators use themselves.
    d = spark.createDataFrame(DOCS, SCHEMA)
    return d.withColumn("size", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("id", F.lit(2)).withColumn("hash", F.lit(3)).withColumn("key", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["size"] == by_id[3]["size"] == by_id[8]["size"] == 0
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))  # reruns agree


def test_secrets(spark, docs, none):
    got = secrets.scan(docs).collect()
    assert len(got) == len(DOCS)
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan(none).count() == 0


def test_line_dedup_edges_of_lines(spark):
    passage = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(4)]
    rows = [(1, "\n".join(passage)), (2, "\r\n".join(passage)), (3, "\n".join("\t" + x for x in passage)), (4, "\n".join(x.replace(" ", "\t ") + " \f" for x in passage))]
    got = {r["doc_id"]: r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert got[1]["_n_removed"] == 0 and all(got[i]["_n_removed"] == 4 and got[i]["text"] == "" for i in (2, 3, 4))


def test_line_dedup(spark, docs, none):
    got = lines.line_dedup(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(DOCS)
    assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, t, *_ in DOCS}  # one copy of the long line only
    assert {r["doc_id"]: r["_n_lines"] for r in got}[2] == 0
    assert lines.line_dedup(none, Scratch(spark, "t")).count() == 0


def test_pack(spark, docs, none):
    got = packing.pack(docs, Scratch(spark, "t"), tokenizer_path()).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 1  # null text: id 0 alone
    assert len([r for r in got if r["doc_id"] == 6]) == 2
    by_seq: dict[int, list] = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.SEQ_LEN
    assert packing.pack(none, Scratch(spark, "t"), tokenizer_path()).count() == 0


def test_language(spark, docs, none):
    got = {r["doc_id"]: r for r in language.language_id(docs, Scratch(spark, "t")).collect()}
    for i in (2, 3, 4, 8):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.language_id(none, Scratch(spark, "t")).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_id(unlabelled, Scratch(spark, "t")).collect()} == {"und"}
    assert language.identify(docs, language.train([], __import__("numpy").zeros(language.SLOTS), 0)).columns == [*docs.columns, "_lang_pred", "_score"]


def test_minhash(spark, docs, none):
    got = minhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(DOCS)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in (2, 3, 8, 6)] == [0, 0, 0, 1]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(r["kept"] for r in got)
    assert minhash.near_duplicates(none, Scratch(spark, "t")).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, None), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, Scratch(spark, "t")).collect()}
    assert len(got) == 8 and got[2]["perplexity"] is None and not got[2]["kept"] and not got[3]["kept"]
    assert quality.classify(none, labels, Scratch(spark, "t")).count() == 0
    free = quality.classify(docs, labels.where("false"), Scratch(spark, "t")).collect()
    assert all(r["kept"] == bool(r["n_grams"]) for r in free)


def test_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "plain words &amp; more"), (4, "u", "plain words &amp; more"), (5, "u", "<article><p>a &lt; b\n c</p><script>x()</script></article>" * 2000), (None, "u", "<<<>>&&")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[1] == ""
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


VECTORS = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0], 1), (None, [1.0, 0.0], 1), (9, [], 1), (50, [0.5, 0.5], 3)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("id", F.lit("x"))


def test_embeddings(spark, vectors):
    got = embeddings.near_duplicates(vectors, Scratch(spark, "t")).collect()
    assert len(got) == len(VECTORS)
    by_id = {r["vec_id"]: r for r in got}
    assert (by_id[0]["n_links"], by_id[1]["n_links"], by_id[1]["component_id"]) == (2, 2, 0)
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["kept"] for i in (2, 3, 4, 5, 6, 7, 8, 9, 50))
    assert by_id[None]["component_id"] is None
    assert embeddings.near_duplicates(vectors.where("false"), Scratch(spark, "t")).count() == 0


def test_top_k(spark, vectors):
    got = embeddings.top_k(vectors, Scratch(spark, "t")).collect()
    assert {r["query_id"] for r in got} == {0, 50}
    best = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    # 0 is [256, 0]; the zero vector takes part, null and non-finite ones don't; the short one is padded
    assert best == [(1, 1, 256 * 512), (2, 1, 256 * 512), (3, 2, 65536), (4, 7, 65536), (5, 8, 65536)]
    assert embeddings.top_k(vectors.where("false"), Scratch(spark, "t")).count() == 0
    # Two rows of one id are two queries, and candidates of each other.
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embeddings.top_k(twins, Scratch(spark, "t")).collect())
    assert got == sorted([(0, 1, 0, 5 * 65536), (0, 2, 1, 2 * 65536), (0, 1, 1, 10 * 65536), (0, 2, 0, 5 * 65536)])


def test_extreme_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e200]), (4, [1e300, 1e300]), (5, [1.0, 1.0]), (6, [0.0, 1e-300])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table, Scratch(spark, "t")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}


def test_pipeline_without_labels(spark):
    plain = spark.createDataFrame(DOCS, SCHEMA)
    for d in (plain.withColumn("lang", F.lit(None).cast("string")), plain.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("en")))):
        got = corpus_pipeline.language_id(spark, d, "")
        assert got.columns == d.columns
        assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 5, 6, 6]


CLASHING = ["gone", "_id", "_hash", "_n", "_t", "_s", "_h", "_size", "_copy", "_lang_pred", "_score", "_n_lines", "_n_removed", "row", "key", "id", "size", "copy", "doc", "kept", "own_id", "pos", "h"]


def test_pipeline_stages(spark, docs):
    plain = spark.createDataFrame(DOCS, SCHEMA)
    for k, c in enumerate(CLASHING):
        plain = plain.withColumn(c, F.lit(k))
    for table in (plain, plain.where("false")):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, d, "")
            if name != "pack":
                assert got.columns == plain.columns
                assert all(r[c] == k for r in got.collect() for k, c in enumerate(CLASHING))
            d = got
        d.count()
