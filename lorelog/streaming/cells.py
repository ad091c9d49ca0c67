"""Cells kept up to date by a stream of commits.

Cells are additive, so a stream's cells summed up equal the batch's.  Late commits are taken up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_cells(commits: DataFrame, who: str, local: str, late: str = "7 days") -> DataFrame:
    """Commits per identity, day and hour; in append mode a day comes out once it is past the watermark."""
    t = F.col(local).cast("timestamp")
    w = F.window("at", "1 day")
    return (
        commits.select(F.col(who).alias("id"), t.alias("at"))
        .withWatermark("at", late)
        .groupBy("id", w.alias("span"), F.hour("at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("commits"))
        .select("id", F.to_date("span.start").alias("day"), "hour", "commits")
    )


def rolling_touches(changes: DataFrame, path: str, local: str, days: int = 30, late: str = "7 days") -> DataFrame:
    """Touches per path in sliding windows that start daily: an approximation of the rolling maximum from below."""
    t = F.col(local).cast("timestamp")
    return (
        changes.select(F.col(path).alias("path"), t.alias("at"))
        .withWatermark("at", late)
        .groupBy("path", F.window("at", f"{days} days", "1 day").alias("span"))
        .agg(F.count(F.lit(1)).alias("touches"))
        .select("path", F.to_date("span.start").alias("start"), "touches")
    )


def sessions(commits: DataFrame, who: str, local: str, gap: str = "2 hours", late: str = "7 days") -> DataFrame:
    """Bouts of work: commits of one identity with less than ``gap`` between them."""
    t = F.col(local).cast("timestamp")
    return (
        commits.select(F.col(who).alias("id"), t.alias("at"))
        .withWatermark("at", late)
        .groupBy("id", F.session_window("at", gap).alias("span"))
        .agg(F.count(F.lit(1)).alias("commits"))
        .select("id", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "commits")
    )
