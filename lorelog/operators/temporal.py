"""When work happens.  Everything derives from additive cells, so a scope's figures are one derivation over its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions import times
from lorelog.functions.numbers import ratio


def moments(commits: DataFrame, who: str, local: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per commit: id, at (local seconds), day, hour, weekday, month, year."""
    t = F.col(local)
    return commits.select(
        F.col(who).alias("id"), times.epoch_seconds(t).alias("at"), F.to_date(t).alias("day"), F.hour(t).alias("hour"), times.monday_zero(t).alias("weekday"), F.month(t).alias("month"), F.year(t).alias("year"), *keep
    )


def cells(m: DataFrame) -> DataFrame:
    """The additive form: commits per identity, year, day and hour."""
    return m.groupBy("id", "year", "day", "weekday", "hour").agg(F.count(F.lit(1)).alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def histogram(m: DataFrame, column: str, values: range) -> DataFrame:
    """Dense: (bucket, commits), zeros included."""
    counts = m.groupBy(F.col(column).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    dense = m.sparkSession.range(values.start, values.stop).toDF("bucket")
    return dense.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("commits"))


def year_histogram(m: DataFrame) -> DataFrame:
    """One row per calendar year from the first to the last, zeros included; no rows for no commits."""
    counts = m.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    dense = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return dense.join(counts, "year", "left").select(F.col("year").cast("long").alias("year"), F.coalesce("n", F.lit(0)).cast("long").alias("commits"))


def day_grid(m: DataFrame) -> DataFrame:
    """Commits per weekday and hour, 7 x 24 rows."""
    counts = m.groupBy("weekday", "hour").agg(F.count(F.lit(1)).alias("n"))
    dense = m.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return dense.join(counts, ["weekday", "hour"], "left").select(
        F.col("weekday").cast("long").alias("weekday"), F.col("hour").cast("long").alias("hour"), F.coalesce("n", F.lit(0)).cast("long").alias("commits")
    )


def _window(by: list[str], order: Column | str) -> Window:
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def streaks(days: DataFrame, by: list[str]) -> DataFrame:
    """Longest run of consecutive dates, and most whole days strictly between neighbouring dates; days: (by, day), different.

    Dates of a group are at most a few ten thousand, so a group fits a task whatever the number of commits.
    """
    w = _window(by, "day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    runs = gaps.withColumn("run", F.sum(F.when(F.col("gap") == 1, 0).otherwise(1)).over(w))
    lengths = runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("length"), F.max("gap").alias("gap"))
    return lengths.groupBy(*by).agg(F.max("length").alias("longest_streak_days"), F.greatest(F.coalesce(F.max("gap"), F.lit(1)) - 1, F.lit(0)).cast("long").alias("longest_silence_days"))


def elapsed_silence(m: DataFrame, by: list[str]) -> DataFrame:
    """Most whole 24 h units between neighbouring commits (the golden outputs' silence); 0 for one commit.

    Only a day's first and last commit can bound the longest of at least a day, so days are reduced before the window.
    """
    ends = m.groupBy(*by, "day").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    gap = F.floor((F.col("first_at") - F.lag("last_at").over(_window(by, "day"))) / 86_400)
    return ends.withColumn("gap", gap).groupBy(*by).agg(F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.lit(0)).cast("long").alias("elapsed_silence_days"))


def profile(m: DataFrame, by: list[str] | None = None, places: int | None = None) -> DataFrame:
    """All scalar figures, one row per group (one row in all without ``by``; nulls over an empty population)."""
    by = by or []
    c = cells(m) if not by else m.groupBy(*by, "day", "weekday", "hour").agg(F.count(F.lit(1)).alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    hour, weekday, n = F.col("hour"), F.col("weekday"), F.col("commits")

    def share(test: Column) -> Column:
        return ratio(F.sum(F.when(test, n).otherwise(0)), F.sum(n), places)

    # a date is that of the earliest or latest instant, which need not be the smallest local date
    main = c.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("commits"),
        share(times.is_night(hour)).alias("night_ratio"),
        share(times.is_early(hour)).alias("early_ratio"),
        share(weekday >= 5).alias("weekend_ratio"),
        share(times.is_office(hour, weekday)).alias("office_hours_ratio"),
        F.sum(F.when(times.is_friday_evening(hour, weekday), n).otherwise(0)).cast("long").alias("friday_evening_count"),
        F.count_distinct("day").cast("long").alias("active_days"),
        F.min(F.struct("first_at", "day"))["day"].alias("first_commit_date"),
        F.max(F.struct("last_at", "day"))["day"].alias("last_commit_date"),
    )
    hours = c.groupBy(*by, "hour").agg(F.sum("commits").alias("n"))
    top = hours.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 6).alias("top"), F.sum("n").alias("all"))
    regular = top.select(*by, ratio(F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x), F.col("all"), places).alias("regularity"))
    days = c.groupBy(*by, "day").agg(F.sum("commits").alias("n"))
    busiest = days.groupBy(*by).agg(F.max(F.struct("n", (-F.unix_date("day")).alias("early"), "day")).alias("x")).select(*by, F.col("x.day").alias("busiest_day"), F.col("x.n").alias("busiest_day_commits"))
    out = main
    for part in (regular, busiest, streaks(days.select(*by, "day"), by), elapsed_silence(m, by)):
        out = out.join(part, by, "left") if by else out.join(F.broadcast(part), F.lit(True), "left")  # one row each
    age = F.datediff("last_commit_date", "first_commit_date").cast("long")
    return out.withColumns({
        "commits_per_active_day": ratio(F.col("commits"), F.col("active_days"), places),
        "repository_age_days": age,
        "span_ratio": ratio(F.col("active_days"), age + 1, places),
    })


def month_delta(m: DataFrame) -> DataFrame:
    """Commits per calendar month with commits, and the change from the one before."""
    counts = m.groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("commits"))
    return counts.withColumn("delta", F.col("commits") - F.lag("commits").over(Window.orderBy("year", "month")))  # one row a month


def year_delta(m: DataFrame) -> DataFrame:
    """Per calendar year its commits, active days and people, and the change of each against the year before (null if that has none)."""
    figures = m.groupBy(F.col("year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("commits"), F.count_distinct("day").alias("active_days"), F.count_distinct("id").alias("people")
    )
    before = figures.select((F.col("year") + 1).alias("year"), *(F.col(c).alias(f"{c}_before") for c in ("commits", "active_days", "people")))
    return figures.join(before, "year", "left").select("year", "commits", "active_days", "people", *((F.col(c) - F.col(f"{c}_before")).alias(f"{c}_delta") for c in ("commits", "active_days", "people")))


def instants(m: DataFrame) -> DataFrame:
    """Per identity: most commits in one local minute, and commits in the first hour of the day."""
    minutes = m.groupBy("id", F.floor(F.col("at") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hour") == 0).alias("first_hour"))
    return minutes.groupBy("id").agg(F.max("n").alias("max_commits_in_one_minute"), F.sum("first_hour").alias("commits_in_hour_0"))
