"""Daily quotas and per-minute rate limits over request events, as batch queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

DAILY_LIMIT, MINUTE_LIMIT = 15, 120


def utc_day(events: DataFrame, ts: str = "ts") -> Column:
    """The UTC day of an instant, whatever the session's time zone; a time without zone is UTC already."""
    at = F.col(ts)
    if isinstance(events.schema[ts].dataType, TimestampType):
        at = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd")


def daily_quota(events: DataFrame, limit: int = DAILY_LIMIT, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds day, used_before, admitted and status: the first ``limit`` requests of a user's UTC day pass, 429 after."""
    own = Window.partitionBy(user, "day").orderBy(ts, tie)
    d = events.withColumn("day", utc_day(events, ts)).withColumn("_n", F.row_number().over(own))
    return d.withColumn("used_before", F.least(F.col("_n") - 1, F.lit(limit))).withColumn("admitted", F.col("_n") <= limit).withColumn("status", F.when(F.col("admitted"), 200).otherwise(429)).drop("_n")


def usage_counts(events: DataFrame, limit: int = DAILY_LIMIT, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, user, day, requests, count, limit): the counter's upserts in closed form, one row a user and day."""
    d = events.groupBy(user, utc_day(events, ts).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    return d.select(F.concat_ws("_", F.col(user).cast("string"), "day").alias("key"), user, "day", "requests", F.least("requests", F.lit(limit)).alias("count"), F.lit(limit).alias("limit"))


def rate_limit(events: DataFrame, limit: int = MINUTE_LIMIT, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds minute and admitted, by tumbling minutes aligned to the epoch."""
    d = events.withColumn("minute", F.date_trunc("minute", F.col(ts)))
    return d.withColumn("admitted", F.row_number().over(Window.partitionBy(key, "minute").orderBy(ts, tie)) <= limit)


def workspace_counts(events: DataFrame, user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Requests of each user by kind."""
    return events.groupBy(user, kind).agg(F.count(F.lit(1)).alias("n"))
