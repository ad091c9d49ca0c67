"""How large changes are.  Input: one row per commit with its effective lines and number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelog.functions.numbers import ratio, round_places
from lorelog.model import LIMITS

#: Upper bounds of the size classes; 0-9 is the first, so that the classes sum to the population.
BUCKETS = ((9, "0-9"), (49, "10-49"), (199, "50-199"), (999, "200-999"))


def sizes(changes: DataFrame, commit: str, path: str, added: Column, deleted: Column, counted: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(commit, kept columns, added, deleted, lines, files) of the counted changes; files are different paths."""
    ok = F.lit(True) if counted is None else counted
    return changes.groupBy(F.col(commit).alias("commit"), *keep).agg(
        F.coalesce(F.sum(F.when(ok, added)), F.lit(0)).cast("long").alias("added"),
        F.coalesce(F.sum(F.when(ok, deleted)), F.lit(0)).cast("long").alias("deleted"),
        F.coalesce(F.sum(F.when(ok, added + deleted)), F.lit(0)).cast("long").alias("lines"),
        F.count_distinct(F.when(ok, F.col(path))).cast("long").alias("files"),
    )


def bucket(lines: Column) -> Column:
    out = F.lit("1000+")
    for top, name in reversed(BUCKETS):
        out = F.when(lines <= top, name).otherwise(out)
    return out


def cells(sized: DataFrame, threshold: int, who: str = "id", year: str = "year") -> DataFrame:
    """The additive form: commits per identity, year and (lines, files, bulk), with their added lines.

    Sums, means and percentiles of any scope are those of its cells, see ``profile_of_cells``.
    """
    return sized.groupBy(F.col(who).alias("id"), F.col(year).alias("year"), "lines", "files", (F.col("lines") > threshold).alias("bulk")).agg(
        F.count(F.lit(1)).alias("commits"), F.sum("added").cast("long").alias("added")
    )


def profile_of_cells(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The figures of ``profile`` from cells: every sum is weighed by the cell's commits."""
    ok, n = ~F.col("bulk"), F.col("commits")
    total = F.sum(F.when(ok, n).otherwise(0))
    part = lambda test: F.sum(F.when(ok & test, n).otherwise(0))
    summed = lambda x: F.sum(F.when(ok, F.col(x) * n).otherwise(0))
    # an exact percentile with frequencies; below, 0.9 by nearest rank is the least value whose running count reaches it
    middle = lambda x: F.percentile(F.when(ok, F.col(x)), 0.5, F.when(ok, n).otherwise(0))

    by = by or []
    keyed = found.withColumn("key_", F.struct(*by) if by else F.lit(1))
    # values of a scope are merged before they are put in order, so a scope's list is as long as its different values
    totals = keyed.groupBy("key_").agg(total.alias("total_"))
    ranks = []
    for x in ("lines", "files"):
        values = keyed.groupBy("key_", x, "bulk").agg(F.sum("commits").alias("commits")).join(totals, "key_")
        ranks.append(values.groupBy("key_", "total_").agg(F.array_sort(F.collect_list(F.when(~F.col("bulk"), F.struct(F.col(x).alias("x"), F.col("commits").alias("n"))))).alias("list")))
    main = keyed.groupBy("key_", *by).agg(
        total.cast("long").alias("commits"), round_places(summed("lines") / total, 1).alias("mean_lines"), round_places(middle("lines"), 1).alias("median_lines"),
        round_places(summed("files") / total, 1).alias("mean_files"), round_places(middle("files"), 1).alias("median_files"),
        ratio(part(F.col("lines") <= 20), total).alias("small_commit_ratio"), ratio(part(F.col("files") == 1), total).alias("single_file_ratio"),
        ratio(F.sum(F.when(ok, F.col("added"))), summed("lines")).alias("addition_ratio"), F.sum(F.when(~ok, n).otherwise(0)).cast("long").alias("bulk_commit_count"),
    )
    for name, rank in zip(("p90_lines", "p90_files"), ranks):
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        step = lambda acc, c: F.struct((acc["seen"] + c["n"]).alias("seen"), F.coalesce(acc["at"], F.when((acc["seen"] + c["n"]) * 10 >= F.col("total_") * 9, c["x"])).alias("at"))
        main = main.join(rank.select("key_", F.aggregate("list", start, step, lambda acc: acc["at"]).alias(name)), "key_", "left")
    return main.drop("key_")


def profile(sized: DataFrame, threshold: int, by: list[str] | None = None) -> DataFrame:
    """Scalar figures over the commits that aren't bulk; percentiles are exact, p90 by nearest rank."""
    ok = F.col("lines") <= threshold
    lines, files = F.when(ok, F.col("lines")), F.when(ok, F.col("files"))
    n = F.count_if(ok)
    return sized.groupBy(*(by or [])).agg(
        n.cast("long").alias("commits"),
        round_places(F.sum(lines) / n, 1).alias("mean_lines"),
        round_places(F.expr(f"percentile(if(lines <= {threshold}, lines, null), 0.5)"), 1).alias("median_lines"),
        F.expr(f"percentile_disc(0.9) within group (order by if(lines <= {threshold}, lines, null))").cast("long").alias("p90_lines"),
        round_places(F.sum(files) / n, 1).alias("mean_files"),
        round_places(F.expr(f"percentile(if(lines <= {threshold}, files, null), 0.5)"), 1).alias("median_files"),
        F.expr(f"percentile_disc(0.9) within group (order by if(lines <= {threshold}, files, null))").cast("long").alias("p90_files"),
        ratio(F.count_if(ok & (F.col("lines") <= 20)), n).alias("small_commit_ratio"),
        ratio(F.count_if(ok & (F.col("files") == 1)), n).alias("single_file_ratio"),
        ratio(F.sum(F.when(ok, F.col("added"))), F.sum(lines)).alias("addition_ratio"),
        F.count_if(~ok).cast("long").alias("bulk_commit_count"),
    )


def buckets(sized: DataFrame, threshold: int) -> DataFrame:
    counts = sized.filter(F.col("lines") <= threshold).groupBy(bucket(F.col("lines")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = [name for _, name in BUCKETS] + ["1000+"]
    dense = sized.sparkSession.createDataFrame([(x,) for x in names], "bucket string")
    return dense.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("commits"))


def largest(sized: DataFrame, threshold: int, date: str, newest: str | None = None) -> DataFrame:
    """The largest commit; of equals the earliest date, then the smallest commit.  ``newest``: a record position whose
    smallest value wins instead, as in the golden outputs."""
    order = [F.desc("lines"), F.asc(newest)] if newest else [F.desc("lines"), F.asc(date), F.asc("commit")]
    return sized.filter(F.col("lines") <= threshold).orderBy(*order).limit(1).select("commit", date, "lines", "files")


def bulk(sized: DataFrame, threshold: int, date: str, limit: int = LIMITS["bulk_commits_listed"]) -> DataFrame:
    return sized.filter(F.col("lines") > threshold).orderBy(F.desc("lines"), F.asc(date), F.asc("commit")).limit(limit).select("commit", date, "lines", "files")
