"""Which files change together.

Commits with more than MAX_PATHS paths make no pairs, which bounds the self-join; paths with fewer changes than the
support can't be in a pair, so they are left out before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.functions import paths
from lorelog.functions.numbers import ratio, significant
from lorelog.model import LIMITS

MAX_PATHS = 50
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.5


def members(changes: DataFrame, commit: str, path: str) -> DataFrame:
    return changes.select(F.col(commit).alias("commit"), F.col(path).alias("path")).distinct()


def qualifying(changes: DataFrame, commit: str = "commit", path: str = "path", support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, max_paths: int = MAX_PATHS) -> DataFrame:
    """All pairs (a, b, support, confidence unrounded) that reach both bounds; the confidence is tested unrounded."""
    each = members(changes, commit, path)
    totals = each.groupBy("path").agg(F.count(F.lit(1)).alias("changes"))
    small = each.groupBy("commit").agg(F.count(F.lit(1)).alias("width")).filter(F.col("width").between(2, max_paths)).select("commit")
    frequent = totals.filter(F.col("changes") >= support)
    kept = each.join(small, "commit", "left_semi").join(frequent, "path")
    a = kept.select("commit", F.col("path").alias("a"), F.col("changes").alias("changes_a"))
    b = kept.select("commit", F.col("path").alias("b"), F.col("changes").alias("changes_b"))
    pairs = a.join(b, "commit").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"), F.first("changes_a").alias("ca"), F.first("changes_b").alias("cb"))
    rated = pairs.filter(F.col("support") >= support).withColumn("confidence", F.col("support") / F.least("ca", "cb"))
    return rated.filter(F.col("confidence") >= confidence).select("a", "b", "support", "confidence")


def pairs(found: DataFrame, limit: int = LIMITS["coupling_pairs"]) -> DataFrame:
    """The listed pairs; ``expected`` where both base names have the same stem."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    listed = found.select("a", "b", "support", significant(F.col("confidence")).alias("confidence"), (paths.stem(a) == paths.stem(b)).alias("expected"))
    return listed.orderBy(F.desc("support"), F.desc("confidence"), "a", "b").limit(limit)


def graph(listed: DataFrame, nodes: int = LIMITS["coupling_graph_nodes"], edges: int = LIMITS["coupling_graph_edges"]) -> DataFrame:
    """Edges by support while both bounds hold; the input is a listed (bounded) set of pairs, so it is walked on the driver."""
    seen: set = set()
    out = []
    for r in listed.orderBy(F.desc("support"), F.desc("confidence"), "a", "b").collect():
        if len(out) == edges or len(seen | {r["a"], r["b"]}) > nodes:
            break
        seen |= {r["a"], r["b"]}
        out.append((r["a"], r["b"], r["support"], r["confidence"]))
    return listed.sparkSession.createDataFrame(out, listed.select("a", "b", "support", "confidence").schema)


def coupled_ratio(found: DataFrame, changes: DataFrame, path: str = "path") -> DataFrame:
    """Share of the changed paths that are in a qualifying pair."""
    coupled = found.select(F.explode(F.array("a", "b")).alias("path")).distinct().agg(F.count(F.lit(1)).alias("coupled"))
    every = changes.agg(F.count_distinct(path).alias("every"))
    return coupled.join(F.broadcast(every)).select(F.col("coupled").cast("long").alias("coupled_files"), ratio(F.col("coupled"), F.col("every")).alias("coupled_file_ratio"))
