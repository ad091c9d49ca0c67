"""Who owns the surviving lines.  ``lines``: (path, owner_id, day, n) with n lines of one owner and day in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions.numbers import ratio
from lorelog.model import LIMITS

ORPHAN_DAYS = 365


def by_owner(lines: DataFrame, by: list[str] | None = None, n: Column | None = None) -> DataFrame:
    n = F.lit(1) if n is None else n
    return lines.groupBy(*(by or []), "owner_id").agg(F.sum(n).cast("long").alias("lines"))


def bus_factor(owned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fewest owners with half of the lines, and the largest owner's share; owned: (by, owner_id, lines).

    Owners with equally many lines are one row with their number before anything is put in order, so a task orders the
    different numbers of lines (their square is bounded by the lines), not the owners.
    """
    by = by or []
    sizes = owned.groupBy(*by, "lines").agg(F.count(F.lit(1)).alias("owners"))
    totals = sizes.groupBy(*by).agg(F.sum(F.col("lines") * F.col("owners")).alias("total"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.desc("lines")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("lines") * F.col("owners")).over(order), F.lit(0))
    marked = sizes.withColumn("before", before)
    marked = marked.join(totals, by) if by else marked.join(F.broadcast(totals))  # one row
    # an owner counts while those before have less than half
    needed = F.expr("(total - 2 * before + 2 * lines - 1) div (2 * lines)")
    return marked.groupBy(*by).agg(
        F.sum(F.greatest(F.lit(0), F.least(F.col("owners"), needed))).cast("long").alias("bus_factor"),
        ratio(F.max("lines"), F.max("total")).alias("largest_share"),
        F.max("total").cast("long").alias("line_count"),
    )


def cells(lines: DataFrame, n: Column | None = None) -> DataFrame:
    """The additive form: surviving lines per owner, year of writing, depth-1 directory and file."""
    n = F.lit(1) if n is None else n
    return lines.groupBy("owner_id", F.year("day").alias("year"), "path").agg(F.sum(n).cast("long").alias("lines"))


def summary(lines: DataFrame, head_day: Column, last_seen: DataFrame, n: Column | None = None) -> DataFrame:
    """line_count, median_line_age_days, first_year_survival_ratio, orphaned_line_ratio; last_seen: (owner_id, last_day)."""
    n = F.lit(1) if n is None else n
    per_day = lines.groupBy("owner_id", "day").agg(F.sum(n).alias("n")).join(last_seen, "owner_id", "left")
    aged = per_day.select("n", F.datediff(head_day, "day").alias("age"), F.year("day").alias("year"), (F.col("last_day").isNull() | (F.datediff(head_day, F.col("last_day")) > ORPHAN_DAYS)).alias("orphan"))
    first = aged.agg(F.min("year").alias("first_year"))
    return aged.join(F.broadcast(first)).agg(
        F.sum("n").cast("long").alias("line_count"),
        F.percentile("age", 0.5, F.col("n")).alias("median_line_age_days"),
        ratio(F.sum(F.when(F.col("year") == F.col("first_year"), F.col("n")).otherwise(0)), F.sum("n")).alias("first_year_survival_ratio"),
        ratio(F.sum(F.when(F.col("orphan"), F.col("n")).otherwise(0)), F.sum("n")).alias("orphaned_line_ratio"),
    )


def age_distribution(lines: DataFrame, n: Column | None = None) -> DataFrame:
    n = F.lit(1) if n is None else n
    return lines.groupBy(F.year("day").cast("long").alias("year")).agg(F.sum(n).cast("long").alias("lines"))


def top_owners(owned: DataFrame, by: list[str], limit: int = LIMITS["identities_per_directory"]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("lines"), "owner_id")
    return owned.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)
