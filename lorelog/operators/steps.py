"""The steps of a replay, from the log and the contents of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.operators import dag, replay


def touched_blobs(log: DataFrame) -> DataFrame:
    """(oid) of every content that a change makes."""
    return log.select(F.explode("files.new_blob").alias("oid")).filter("oid is not null").distinct()


def steps(log: DataFrame, annotated: DataFrame, contents: DataFrame, head: str) -> tuple[DataFrame, DataFrame]:
    """(rows of replay.STEP, the graph (hash, parents)) of the commits that ``head`` reaches.

    log: all diffs of all commits (a merge has one a parent that differs); annotated: one row per commit; contents: (oid,
    content, oversized).  Commits count in the events if they are analysed and not bulk.  ``seq`` runs from the newest
    commit, and no commit stands before its child, so it is a topological order.
    """
    commits = log.filter("diff_no = 0").select("hash", "tree", "parents")
    graph = commits.select("hash", "parents")
    known = dag.ancestors(graph.select(F.col("hash").alias("child"), F.explode("parents").alias("parent")), head)
    reached = annotated.join(known, F.col("hash") == F.col("node"), "left_semi").select(
        "hash", (-F.col("seq")).cast("int").alias("position"), F.col("is_merge").alias("merge"), F.col("identity_id").alias("author"),
        F.unix_date("active_date").alias("day"), "year", (~F.col("excluded") & ~F.col("is_bulk")).alias("counted"),
    )
    files = log.select("hash", "diff_no", "is_merge", F.inline("files"))
    plain = files.filter("not is_merge").select("hash", "path", "previous_path", "new_blob", F.lit(None).cast("array<struct<path:string,blob:string>>").alias("versions"), F.when(F.col("is_binary"), True).alias("binary"))
    places = dag.merge_diff_parents(commits.filter(F.size("parents") > 1).unionByName(commits.filter(F.size("parents") <= 1)))
    diffs = files.filter("is_merge").join(places, ["hash", "diff_no"]).select("hash", "parent_no", "path", "previous_path", "old_blob", "new_blob")
    merged = dag.merge_changes(commits, diffs).select("hash", "path", F.lit(None).cast("string").alias("previous_path"), "new_blob", F.col("parents").alias("versions"), F.lit(None).cast("boolean").alias("binary"))
    rows = plain.unionByName(merged).join(reached, "hash").join(contents.select(F.col("oid").alias("new_blob"), "content", "oversized"), "new_blob", "left")
    names = [x.split()[0] for x in replay.STEP.replace("struct<path:string,blob:string>", "x").split(", ")]
    return rows.withColumn("oversized", F.coalesce("oversized", F.lit(False))).select(*names), graph


def check_tree(replayed: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, reason) where the files that the replay ends with and the tree's files disagree; no rows if they agree."""
    mine = replayed.filter("kind in ('file', 'binary', 'large')").select("path", F.lit(True).alias("replayed"))
    theirs = tree.filter("type = 'blob'").select("path", F.lit(True).alias("present"))
    both = mine.join(theirs, "path", "full")
    return both.filter("replayed is null or present is null").select("path", F.when(F.col("present").isNull(), "not in the tree").otherwise("not replayed").alias("reason"))
