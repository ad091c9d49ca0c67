"""Files that change often and are complex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions.numbers import significant
from lorelog.model import LIMITS

CHURN_DAYS = 30
CHURN_LEAST = 5
DEPTH_CAP = 20


def churn(changes: DataFrame, path: str = "path", at: str = "at", days: int = CHURN_DAYS, least: int = CHURN_LEAST, limit: int = LIMITS["churn_files"]) -> DataFrame:
    """Most touches in any rolling window of ``days`` times 24 h, both ends included.

    Touches of one second are one row, and paths with fewer touches in all than ``least`` can't qualify, before the window.
    """
    touches = changes.groupBy(F.col(path).alias("path"), F.col(at).alias("at")).agg(F.count(F.lit(1)).alias("k"))
    total = touches.groupBy("path").agg(F.sum("k").alias("total")).filter(F.col("total") >= least)
    w = Window.partitionBy("path").orderBy("at").rangeBetween(-days * 86_400, 0)
    rolled = touches.join(total, "path").withColumn("n", F.sum("k").over(w))
    most = rolled.groupBy("path").agg(F.max("n").alias("window_commits"), F.max("total").alias("total_commits")).filter(F.col("window_commits") >= least)
    return most.orderBy(F.desc("window_commits"), F.desc("total_commits"), "path").limit(limit)


def frequency(changes: DataFrame, commit: str = "commit", path: str = "path") -> DataFrame:
    return changes.select(F.col(path).alias("path"), F.col(commit).alias("commit")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("change_frequency"))


def complexity(lines: DataFrame) -> DataFrame:
    """(path, complexity_proxy, lines) of (path, line_no, text): mean indent depth times log2 of the non-blank lines.

    The unit is the most common positive increment of leading spaces between neighbouring non-blank lines, the smaller
    of equals, 1 if there is none; a tab is a unit.
    """
    blank = F.col("text").rlike("^\\s*$")
    lead = F.regexp_extract("text", "^([ \\t]*)", 1)
    tabs = F.length(lead) - F.length(F.regexp_replace(lead, "\\t", ""))
    full = lines.filter(~blank).select("path", "line_no", tabs.alias("tabs"), (F.length(lead) - tabs).alias("spaces"))
    step = F.col("spaces") - F.lag("spaces").over(Window.partitionBy("path").orderBy("line_no"))
    steps = full.withColumn("step", step).filter("step > 0").groupBy("path", "step").agg(F.count(F.lit(1)).alias("n"))
    unit = steps.groupBy("path").agg(F.max(F.struct("n", (-F.col("step")).alias("small")))["small"].alias("small")).select("path", (-F.col("small")).alias("unit"))
    joined = full.join(unit, "path", "left").withColumn("depth", F.least(F.col("tabs") + F.col("spaces") / F.coalesce("unit", F.lit(1)), F.lit(float(DEPTH_CAP))))
    return joined.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum("depth").alias("depth")).select(
        "path", (F.col("depth") / F.col("lines") * F.log2(F.col("lines").cast("double"))).alias("complexity_proxy"), "lines"
    )


def hotspots(frequency: DataFrame, complexity: DataFrame, limit: int = LIMITS["hotspot_entries"]) -> DataFrame:
    """Product of both, each min-max normalised over the files that have a complexity (0 where all are equal)."""
    both = complexity.join(frequency, "path", "left").select("path", F.coalesce("change_frequency", F.lit(0)).cast("double").alias("f"), F.col("complexity_proxy").alias("c"))
    ends = both.agg(*(g(x).alias(f"{n}_{x}") for x in "fc" for n, g in (("least", F.min), ("most", F.max))))
    scaled = [F.when(F.col(f"most_{x}") > F.col(f"least_{x}"), (F.col(x) - F.col(f"least_{x}")) / (F.col(f"most_{x}") - F.col(f"least_{x}"))).otherwise(0.0) for x in "fc"]
    rated = both.join(F.broadcast(ends)).select(
        "path", F.col("f").cast("long").alias("change_frequency"), significant(F.col("c")).alias("complexity_proxy"), significant(scaled[0] * scaled[1]).alias("hotspot_score")
    )
    return rated.orderBy(F.desc("hotspot_score"), "path").limit(limit)
