"""The axes of interpretation beyond commit times: one row per person, and one row for the repository.

``commits``: (id, hash, day, at, lines, files, added, deleted, subject, body, bulk, assisted), analysed ones.
``verbosity`` is the mean of the subject's mean length over 72 (1 at most) and the share of commits with a body.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions import paths, text
from lorelog.functions.numbers import ratio
from lorelog.operators import messages

SUBJECT_WIDTH = 72


def after_return(moments: DataFrame) -> DataFrame:
    """(id, commits_after_return): commits after the person's longest silence, the earliest of equals.

    A day's first and last commit bound every silence, so days are reduced before the window.
    """
    days = moments.groupBy("id", "day").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("id").orderBy("day")
    gap = F.col("first_at") - F.lag("last_at").over(order)
    later = F.sum("n").over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = days.withColumns({"gap": gap, "later": later}).filter("gap is not null")
    return marked.groupBy("id").agg(F.max(F.struct("gap", (-F.col("first_at")).alias("early"), "later"))["later"].cast("long").alias("commits_after_return"))


def sizes(commits: DataFrame, p90_files) -> DataFrame:
    ok = ~F.col("bulk")
    n = F.count_if(ok)
    return commits.groupBy("id").agg(
        ratio(F.count_if(ok & (F.col("lines") <= 20)), n).alias("granularity"),
        F.least(F.lit(1.0), F.sum(F.when(ok, F.col("files"))) / n / F.lit(float(p90_files or 1) or 1.0)).alias("breadth"),
        F.count_if(F.col("lines") == 1).alias("single_line_commits"),
        F.max(F.when(ok, F.col("lines"))).alias("largest_commit_lines"),
        ratio(F.sum(F.when(ok, F.col("deleted"))), F.sum(F.when(ok, F.col("lines")))).alias("deletion_ratio"),
        ratio(F.count_if(ok & (F.col("files") == 1)), n).alias("single_file_ratio"),
    )


def words(commits: DataFrame) -> DataFrame:
    s = F.col("subject")
    fix = F.when(text.is_conventional(s), text.conventional_type(s)).otherwise(text.keyword_class(s)) == "fix"
    told = messages.profile(commits, by=["id"]).select(
        "id", F.col("conventional_ratio").alias("formality"), "mean_subject_length", F.col("very_short_count").alias("very_short_subjects"), "emoji_ratio",
        F.col("revert_count").alias("revert_commits"), F.col("fix_typo_count").alias("fix_typo_commits"),
        ((F.least(F.lit(1.0), F.col("mean_subject_length") / SUBJECT_WIDTH) + F.col("body_ratio")) / 2).alias("verbosity"),
    )
    return told.join(commits.groupBy("id").agg(ratio(F.count_if(fix), F.count(F.lit(1))).alias("fix_share")), "id")


def days(commits: DataFrame) -> DataFrame:
    month, day = F.month("day"), F.dayofmonth("day")
    return commits.groupBy("id").agg(
        F.count_if(((month == 12) & (day == 25)) | ((month == 1) & (day == 1))).alias("commits_on_dec_25_or_jan_1"),
        F.count_if((month == 2) & (day == 29)).alias("commits_on_feb_29"),
        ratio(F.count_if("assisted"), F.count(F.lit(1))).alias("assistance"),
    )


def places(touched: DataFrame, head: DataFrame, commits: DataFrame) -> DataFrame:
    """touched: (id, commit, path, is_new); head: (path)."""
    top = paths.directory(F.col("path"), 1)
    present = head.agg(F.count_distinct(top).alias("present"))
    own = touched.groupBy("id").agg(F.count_distinct(top).alias("mine"), F.count_distinct(F.when(F.col("is_new"), F.col("commit"))).alias("founding"), F.count_distinct(F.when(F.col("is_new"), F.col("path"))).alias("new_files_created"))
    total = commits.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    joined = own.join(total, "id").join(F.broadcast(present))  # one row
    return joined.select("id", F.least(F.lit(1.0), ratio(F.col("mine"), F.col("present"))).alias("reach"), ratio(F.col("founding"), F.col("total")).alias("new_file_share"), "new_files_created")


def lines(owned: DataFrame, events: DataFrame) -> DataFrame:
    """owned: (path, owner_id, n); events: (kind, editor, lines)."""
    top = owned.groupBy("owner_id", paths.directory(F.col("path"), 1).alias("directory")).agg(F.sum("n").alias("n"))
    per = top.groupBy(F.col("owner_id").alias("id")).agg(F.sum("n").alias("alive"), F.max(F.when(F.col("directory").isNotNull(), F.col("n"))).alias("most"))
    alone = top.filter("directory is not null").groupBy("directory").agg(F.count(F.lit(1)).alias("owners"), F.min("owner_id").alias("id")).filter("owners = 1").groupBy("id").agg(F.count(F.lit(1)).alias("sole_owner_of_directories"))
    wrote = events.filter("kind <> 'deletion'").groupBy(F.col("editor").alias("id")).agg(F.sum("lines").alias("wrote"))
    return per.join(wrote, "id", "left").join(alone, "id", "left").select(
        "id", ratio(F.col("most"), F.col("alive")).alias("concentration"), F.least(F.lit(1.0), ratio(F.col("alive"), F.col("wrote"))).alias("persistence"), F.coalesce("sole_owner_of_directories", F.lit(0)).alias("sole_owner_of_directories"),
    )


def holders(touched: DataFrame, owned: DataFrame, oldest: str | None, pair: tuple[str, str] | None, hotspot: str | None) -> DataFrame:
    """(id, flag...) of at most three people: who touched the oldest untouched file last, who touched both files of the top
    pair most, and who owns most lines of the top hotspot; the smaller id of equals."""
    spark = touched.sparkSession
    flags: dict[str, str | None] = {}
    row = touched.filter(F.col("path") == oldest).orderBy(F.desc("at"), "id").select("id").first() if oldest else None
    flags["owns_oldest_untouched_file"] = row["id"] if row else None
    row = None
    if pair:
        both = touched.filter(F.col("path").isin(list(pair))).groupBy("id").agg(F.count_distinct("path").alias("k"), F.count_distinct("commit").alias("n")).filter("k = 2")
        row = both.orderBy(F.desc("n"), "id").first()
    flags["owns_top_coupled_pair"] = row["id"] if row else None
    row = owned.filter(F.col("path") == hotspot).groupBy("owner_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "owner_id").first() if hotspot else None
    flags["owns_top_hotspot"] = row["owner_id"] if row else None
    ids = sorted({x for x in flags.values() if x})
    return spark.createDataFrame([(i, *(x == i for x in flags.values())) for i in ids], "id string, " + ", ".join(f"{k} boolean" for k in flags))


#: rank_<name> is the place (1: the greatest) on an axis.
RANKS = {
    "largest_commit": "largest_commit_lines", "new_files": "new_files_created", "message_length": "mean_subject_length", "single_file_focus": "single_file_ratio",
    "reach": "reach", "collaboration": "collaboration", "restoration": "restoration",
}


def person_table(time_axes: DataFrame, parts: list[DataFrame], constants: dict[str, float | None], limit: int) -> DataFrame:
    """All axes, one row per individually represented person, who are ``limit`` at most (so ranks need no split)."""
    few = time_axes.orderBy(F.desc("commits"), "id").limit(limit)
    wide = reduce(lambda d, part: d.join(part, "id", "left"), parts, few)
    for name in ("owns_oldest_untouched_file", "owns_top_coupled_pair", "owns_top_hotspot", "first_assisted_commit"):
        if name in wide.columns:
            wide = wide.withColumn(name, F.coalesce(name, F.lit(False)))
    wide = wide.withColumns({k: F.lit(v).cast("double") for k, v in constants.items()})
    for name, axis in RANKS.items():
        if axis in wide.columns:
            wide = wide.withColumn(f"rank_{name}", F.when(F.col(axis).isNotNull(), F.rank().over(Window.orderBy(F.col(axis).desc_nulls_last()))).cast("long"))
    return wide
