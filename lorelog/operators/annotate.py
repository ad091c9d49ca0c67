"""The semantic layer: what each commit counts as, decided once for all families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.functions import paths, times
from lorelog.model import Config
from lorelog.operators import identities


def annotate(commits: DataFrame, config: Config, mapped: DataFrame | None = None, attributes: str = "") -> DataFrame:
    """Adds identity, exclusion, effective lines, bulk flag, local time and active date; one row per commit.

    commits: COMMITS of the model (files of a merge are ignored for sizes).
    """
    c = identities.resolve(commits, config, mapped)
    side = config.date_source
    c = c.withColumn("local_ts", times.local_time(F.col(f"{side}_ts"), F.col(f"{side}_off_min"))).withColumn("active_date", F.to_date("local_ts")).withColumn("year", F.year("active_date"))
    changes = file_changes(c, config, attributes)
    counted = ~F.col("excluded") & ~F.col("is_binary")
    sums = changes.groupBy("hash").agg(F.sum(F.when(counted, F.col("added") + F.col("deleted")).otherwise(0)).alias("effective_lines"), F.count_distinct(F.when(~F.col("excluded"), F.col("path"))).alias("included_files"))
    c = c.join(sums, "hash", "left").withColumns({
        "effective_lines": F.coalesce("effective_lines", F.lit(0)), "included_files": F.coalesce("included_files", F.lit(0)),
        "merge_excluded": F.col("is_merge") & F.lit(not config.count_merges),
    })
    c = c.withColumn("excluded", F.col("merge_excluded") | F.col("author_excluded"))
    return c.withColumn("is_bulk", ~F.col("excluded") & (F.col("effective_lines") > config.outlier_threshold_lines))


def file_changes(commits: DataFrame, config: Config, attributes: str = "") -> DataFrame:
    """One row per changed file: hash, pos, the change's fields, excluded."""
    rows = commits.select("hash", F.posexplode("files").alias("pos", "f")).select("hash", "pos", "f.*")
    return paths.with_exclusion(rows, "path", config.exclude_paths, attributes)


def analysed(annotated: DataFrame, year: int = 0) -> DataFrame:
    out = annotated.filter(~F.col("excluded"))
    return out.filter(F.col("year") == year) if year else out


def line_scoped(annotated: DataFrame) -> DataFrame:
    return analysed(annotated).filter(~F.col("is_bulk"))


def scoped_changes(annotated: DataFrame, changes: DataFrame) -> DataFrame:
    """Included changes of line-scoped commits; commits without one drop out."""
    return changes.filter(~F.col("excluded")).join(line_scoped(annotated).select("hash", "identity_id", "local_ts", "active_date"), "hash")


def summary(annotated: DataFrame) -> DataFrame:
    return annotated.agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(~F.col("excluded")).alias("analysed"), F.count_if("is_merge").alias("merges"),
        F.count_if("author_excluded").alias("excluded_authors"), F.count_if("is_bulk").alias("bulk"),
    )
