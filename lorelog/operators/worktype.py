"""What kind of work line edits are.  ``events``: (kind, editor, owner, age_days, lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions.numbers import ratio

CLASSES = ("new_work", "rework", "help_others", "legacy_refactor")


def work_class(kind: Column, own: Column, age: Column, window: int) -> Column:
    """Additions are new work; an age below the window (negative ones too) is recent, and a recent edit of one's own line rework."""
    return F.when(kind == "addition", "new_work").when(age >= window, "legacy_refactor").when(own, "rework").otherwise("help_others")


def consecutive_events(changes: DataFrame, key: str, who: str, day: str, order: list[str]) -> DataFrame:
    """Events of a linear history of keys: the first touch is an addition, each further one replaces the touch before."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.select(
        F.when(F.lag(who).over(w).isNull(), "addition").otherwise("replacement").alias("kind"),
        F.col(who).alias("editor"),
        F.lag(who).over(w).alias("owner"),
        F.datediff(F.col(day), F.lag(day).over(w)).alias("age_days"),
        F.year(day).alias("year"),
        F.lit(1).alias("lines"),
    )


def breakdown(events: DataFrame, window: int, individual: DataFrame | None = None) -> DataFrame:
    """Lines per editor, previous owner and class.  Whether a line is one's own is decided before the identities that
    aren't individual fold into the bucket (null)."""
    e = events.withColumn("work_class", work_class(F.col("kind"), F.col("editor") == F.col("owner"), F.col("age_days"), window))
    if individual is not None:
        ids = individual.select(F.col("id"))
        for side in ("editor", "owner"):
            named = F.broadcast(ids.select(F.col("id").alias(f"__{side}")))  # at most the identity bound
            e = e.join(named, F.col(side) == F.col(f"__{side}"), "left").drop(side).withColumnRenamed(f"__{side}", side)
    return e.groupBy("editor", F.when(F.col("work_class") != "new_work", F.col("owner")).alias("owner"), "work_class").agg(F.sum("lines").cast("long").alias("lines"))


def cells(events: DataFrame, window: int) -> DataFrame:
    """The additive form: lines per editor, year of the edit, previous owner and class."""
    e = events.withColumn("work_class", work_class(F.col("kind"), F.col("editor") == F.col("owner"), F.col("age_days"), window))
    return e.groupBy("editor", "year", F.when(F.col("work_class") != "new_work", F.col("owner")).alias("owner"), "work_class").agg(F.sum("lines").cast("long").alias("lines"))


def shares(cells: DataFrame, window: int) -> DataFrame:
    """One row: the classes' shares, the number of events and the window."""
    total = F.sum("lines")
    return cells.agg(
        *(ratio(F.sum(F.when(F.col("work_class") == c, F.col("lines")).otherwise(0)), total).alias(c) for c in CLASSES),
        F.coalesce(total, F.lit(0)).cast("long").alias("classified_line_count"),
        F.lit(window).cast("long").alias("recency_window_days"),
    )


def selected_shares(cells: DataFrame, ids: list, window: int) -> DataFrame:
    """Shares of a selection as one person: help among the selected is rework."""
    own = cells.filter(F.col("editor").isin(ids))
    merged = own.withColumn("work_class", F.when((F.col("work_class") == "help_others") & F.col("owner").isin(ids), "rework").otherwise(F.col("work_class")))
    return shares(merged, window)


def person_shares(cells: DataFrame) -> DataFrame:
    """Each editor's shares as axes: creation, restoration, revision, collaboration."""
    names = {"creation": "new_work", "restoration": "legacy_refactor", "revision": "rework", "collaboration": "help_others"}
    return cells.groupBy(F.col("editor").alias("id")).agg(*(ratio(F.sum(F.when(F.col("work_class") == c, F.col("lines")).otherwise(0)), F.sum("lines")).alias(axis) for axis, c in names.items()))
