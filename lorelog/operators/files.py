"""Which files are touched.  ``changes``: (commit, path, at, ...), one row per changed file; ``head``: the files that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.functions import paths
from lorelog.model import LIMITS

DIRECTORY_MIN_COMMITS = 10


def touched(changes: DataFrame, path: str = "path", date: str = "date") -> DataFrame:
    """(path, entries, last date): an entry per changed file, repeated paths in a commit too."""
    return changes.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.max(date).alias("last_modified"))


def most_modified(changes: DataFrame, head: DataFrame, limit: int = LIMITS["most_modified_files"]) -> DataFrame:
    here = head.select("path").distinct().withColumn("here", F.lit(True))
    top = touched(changes).orderBy(F.desc("commits"), "path").limit(limit)  # the bound comes before the join
    return top.join(here, "path", "left").select("path", "commits", F.col("here").isNull().alias("removed")).orderBy(F.desc("commits"), "path")


def oldest_untouched(changes: DataFrame, head: DataFrame) -> DataFrame:
    return touched(changes).join(head.select("path").distinct(), "path", "left_semi").orderBy("last_modified", "path").limit(1).select("path", "last_modified")


def extensions(changes: DataFrame, head: DataFrame, limit: int = LIMITS["extensions"]) -> DataFrame:
    """(measure, extension, n): the most frequent by touching commits and by files that exist."""
    ext = paths.extension(F.col("path"))
    by_commits = changes.select("commit", ext.alias("extension")).distinct().groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    by_files = head.select("path").distinct().groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for name, table in (("commits", by_commits), ("files", by_files)):
        out.append(table.filter("extension <> ''").orderBy(F.desc("n"), "extension").limit(limit).select(F.lit(name).alias("measure"), "extension", "n"))
    return out[0].unionByName(out[1])


def with_directories(changes: DataFrame, path: str = "path") -> DataFrame:
    """A row per change and directory at depth 1 and 2: adds depth and directory."""
    p = F.col(path)
    every = F.array(*(F.struct(F.lit(d).cast("long").alias("depth"), paths.directory(p, d).alias("directory")) for d in (1, 2)))
    return changes.select("*", F.inline(F.filter(every, lambda x: x["directory"].isNotNull())))


def directory_activity(changes: DataFrame, least: int = DIRECTORY_MIN_COMMITS, limit: int = LIMITS["directory_activity_entries"]) -> DataFrame:
    p = F.col("path")
    # paths are reduced to their directories before anything shuffles; a depth-2 directory says its depth-1 one
    pairs = changes.select("commit", paths.directory(p, 1).alias("upper"), paths.directory(p, 2).alias("lower")).filter("upper is not null").distinct()
    out = []
    for depth, name, rows in ((1, "upper", pairs.select("commit", "upper").distinct()), (2, "lower", pairs.filter("lower is not null"))):
        counts = rows.groupBy(F.col(name).alias("directory")).agg(F.count(F.lit(1)).alias("commits")).filter(F.col("commits") >= least)
        out.append(counts.select(F.lit(depth).cast("long").alias("depth"), "directory", "commits"))
    return out[0].unionByName(out[1]).orderBy(F.desc("commits"), "directory").limit(limit)


def counts(changes: DataFrame, head: DataFrame) -> DataFrame:
    """One row: head_file_count, tracked_text_file_count, deleted_file_count, rename_count, new_file_commits, new_file_count, directories.

    head: (path, text boolean); changes also have previous_path and is_new.
    """
    there = head.agg(F.count_distinct("path").cast("long").alias("head_file_count"), F.count_distinct(F.when(F.col("text"), F.col("path"))).cast("long").alias("tracked_text_file_count"))
    gone = changes.select("path").distinct().join(head.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("deleted_file_count"))
    made = changes.agg(
        F.count("previous_path").cast("long").alias("rename_count"),
        F.count_distinct(F.when(F.col("is_new"), F.col("commit"))).cast("long").alias("new_file_commits"),
        F.count_distinct(F.when(F.col("is_new"), F.col("path"))).cast("long").alias("new_file_count"),
        F.count_distinct(paths.directory(F.col("path"), 1)).cast("long").alias("directories_touched"),
    )
    folders = head.agg(F.count_distinct(paths.directory(F.col("path"), 1)).cast("long").alias("directory_count"))
    return there.join(F.broadcast(gone)).join(F.broadcast(made)).join(F.broadcast(folders))  # one row each


def cells(changes: DataFrame, who: str = "id", date: str = "date") -> DataFrame:
    """The additive form: entries, renames and new files per identity, year and path, with the last date."""
    return changes.groupBy(F.col(who).alias("id"), F.year(date).alias("year"), "path").agg(
        F.count(F.lit(1)).alias("entries"), F.max(date).alias("last_modified"), F.count("previous_path").alias("renames"), F.count_if("is_new").alias("new_files")
    )


def directories_of_cells(found: DataFrame) -> DataFrame:
    """(depth, directory, entries, paths) of the cells of any scope: directory names unite across cells, entries add up."""
    per_path = found.groupBy("path").agg(F.sum("entries").alias("entries"))  # a path once, before it is spread over its directories
    return with_directories(per_path).groupBy("depth", "directory").agg(F.sum("entries").cast("long").alias("entries"), F.count(F.lit(1)).alias("paths"))
