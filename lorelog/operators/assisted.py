"""Commits that carry the marks of an agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelog.functions.numbers import ratio, round_places

RULES_VERSION = "1"
#: Tool and the pattern of its co-author trailer or signature line.
RULES = (
    ("assistant", "(?im)^co-authored-by: *(assistant|ai assistant|code assistant)\\b"),
    ("agent", "(?im)^co-authored-by: *[^<\\n]*\\b(agent|copilot)\\b"),
    ("generated", "(?im)^(generated|assisted)[ -](with|by):? "),
)


def last_paragraph(message: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.coalesce(message, F.lit("")), "\\s+$", ""), "\\n[ \\t\\r]*\\n"), -1)


def tool_of(message: Column, rules=RULES) -> Column:
    """The first rule's tool: trailers count in the last paragraph, signature lines anywhere; null for none."""
    out = F.lit(None).cast("string")
    for tool, pattern in reversed(rules):
        where = last_paragraph(message) if "co-authored" in pattern else F.coalesce(message, F.lit(""))
        out = F.when(where.rlike(pattern), tool).otherwise(out)
    return out


def summary(commits: DataFrame, lines: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """One row.  commits: (commit, id, day, effective, bulk, assisted); lines: surviving (commit, n); events: (commit that
    wrote the line, null for additions' previous owner; kind, age_days, writer commit, n)."""
    a = F.col("assisted")
    non_bulk = ~F.col("bulk")
    base = commits.agg(
        F.count_if(a).cast("long").alias("assisted_commit_count"),
        ratio(F.count_if(a), F.count(F.lit(1))).alias("assisted_commit_ratio"),
        F.min(F.when(a, F.col("day"))).alias("first_assisted_commit_date"),
        round_places(F.avg(F.when(a & non_bulk, F.col("effective"))), 1).alias("assisted_mean_lines"),
        round_places(F.avg(F.when(~a & non_bulk, F.col("effective"))), 1).alias("unassisted_mean_lines"),
        ratio(F.count_distinct(F.when(a, F.col("id"))), F.count_distinct("id")).alias("assisted_identity_ratio"),
    )
    flags = commits.select("commit", "assisted")
    alive = lines.join(flags, "commit").agg(ratio(F.sum(F.when(a, F.col("n")).otherwise(0)), F.sum("n")).alias("assisted_line_share"), F.sum(F.when(a, F.col("n")).otherwise(0)).alias("alive_a"), F.sum(F.when(~a, F.col("n")).otherwise(0)).alias("alive_u"))
    wrote = events.filter("kind <> 'deletion'").join(flags, "commit").agg(F.sum(F.when(a, F.col("n")).otherwise(0)).alias("wrote_a"), F.sum(F.when(~a, F.col("n")).otherwise(0)).alias("wrote_u"))
    again = events.filter((F.col("kind") != "addition") & (F.col("age_days") < window)).select(F.col("writer").alias("commit"), "n").join(flags, "commit")
    again = again.agg(F.sum(F.when(a, F.col("n")).otherwise(0)).alias("again_a"), F.sum(F.when(~a, F.col("n")).otherwise(0)).alias("again_u"))
    row = base.join(F.broadcast(alive)).join(F.broadcast(wrote)).join(F.broadcast(again))  # one row each
    names = {"a": "assisted", "u": "unassisted"}
    extra = {f"{name}_{what}_ratio": ratio(F.coalesce(F.col(f"{column}_{k}"), F.lit(0)), F.col(f"wrote_{k}")) for k, name in names.items() for what, column in (("rework", "again"), ("survival", "alive"))}
    return row.withColumns(extra | {"detection_rules_version": F.lit(RULES_VERSION)}).drop("alive_a", "alive_u", "wrote_a", "wrote_u", "again_a", "again_u")


def tools(commits: DataFrame, tool: str = "tool") -> DataFrame:
    return commits.filter(F.col(tool).isNotNull()).groupBy(F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("commits"))
