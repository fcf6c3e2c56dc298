"""The quota and the rate limit over streams.

The watermark of 10 minutes and its handling of late requests are this engine's own choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheafwork.operators.quota import DAILY_LIMIT, MINUTE_LIMIT, utc_day

WATERMARK = "10 minutes"


def _admit(limit: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one user's requests of one day and batch
        n = used + 1 + pd.Series(range(len(rows)), index=rows.index)
        rows = rows.assign(admitted=n <= limit)
        state.update((int(min(limit, used + len(rows))),))
        day = pd.Timestamp(key[1], tz="UTC")
        state.setTimeoutTimestamp(max(int((day + pd.Timedelta(days=1)).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["event_id", "user_id", "ts", "day", "admitted"]]

    return run


def daily_quota_stream(events: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """(event_id, user_id, ts, day, admitted) of a stream of requests; a day's counter ends with the watermark.

    Within a micro-batch requests count in order of time and id; across batches, in order of arrival.
    """
    d = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK)
    d = d.withColumn("day", utc_day(d))
    return d.groupBy("user_id", "day").applyInPandasWithState(_admit(limit), "event_id long, user_id long, ts timestamp, day string, admitted boolean", "used int", "append", GroupStateTimeout.EventTimeTimeout)


def rate_counts_stream(events: DataFrame, limit: int = MINUTE_LIMIT, key: str = "user_id") -> DataFrame:
    """(key, minute, requests, rejected) once a minute is past the watermark."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 minute"), key).agg(F.count(F.lit(1)).alias("requests"))
    return d.select(key, F.col("window.start").alias("minute"), "requests", F.greatest(F.col("requests") - limit, F.lit(0).cast("long")).alias("rejected"))
