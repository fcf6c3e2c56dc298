"""Streams against their batch versions, and the file sources and sinks."""

from pyspark.sql import functions as F

from sheafwork.operators import quota
from sheafwork.sources import files
from sheafwork.streaming import quota as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def play(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_daily_quota_stream(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = play(spark, streams.daily_quota_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), 1), "admitted")
    want = {(r["event_id"], r["admitted"]) for r in quota.daily_quota(events, 1).collect()}
    assert {(r["event_id"], r["admitted"]) for r in got.collect()} == want
    assert any(not a for _, a in want)


def test_rate_counts_stream(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = {(r["event_type"], r["minute"]): r["requests"] for r in play(spark, streams.rate_counts_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), 1, "event_type"), "rates").collect()}
    want = {(r["event_type"], r["m"]): r["n"] for r in events.groupBy("event_type", F.date_trunc("minute", "ts").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # minutes that the watermark has passed


def test_usage_sink(spark, tmp_path):
    path = str(tmp_path / "usage")
    events = spark.read.parquet(EVENTS)
    counts = quota.usage_counts(events, 3)
    files.upsert_usage(spark, path, counts)
    files.upsert_usage(spark, path, counts)
    got = {r["key"]: r["count"] for r in spark.read.parquet(path).collect()}
    assert got == {r["key"]: min(3, 2 * r["count"]) for r in counts.collect()}


class Broken:
    def read(self, content):
        raise ValueError("bad")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "c.docx").write_bytes(b"x")
    found = files.binary_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: (r["kind"], r["status"]) for r in found.collect()} == {"a.txt": ("text", "ok"), "b.PDF": ("pdf", "ok"), "c.docx": ("unsupported", "unsupported")}
    pages = files.read_pages(found, {"text": files.PlainBytes, "pdf": Broken}).collect()
    assert sorted((r["engine"], r["page"], r["text"], r["error"] or "") for r in pages) == [("pdf", 0, "", "ValueError"), ("text", 1, "one", ""), ("text", 2, "two", ""), ("unsupported", 0, "", "unavailable")]


def test_days_are_utc(spark):
    rows = [(1, 7, "2024-01-01T23:30:00Z"), (2, 7, "2024-01-02T00:30:00Z")]
    d = spark.createDataFrame(rows, "event_id long, user_id long, at string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", z)
            e = d.withColumn("ts", F.to_timestamp("at"))
            assert [r["day"] for r in quota.daily_quota(e).orderBy("event_id").collect()] == ["2024-01-01", "2024-01-02"]
            assert sorted(r["day"] for r in quota.usage_counts(e).collect()) == ["2024-01-01", "2024-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
