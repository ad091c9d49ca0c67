"""Stored intermediate tables, joins with hot keys, and connected components."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows counts as hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 200


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where the session names none, one of our own if
    driver and executors are one process, and an error otherwise."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "") or ""):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or _own_root()


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lorelog-")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes the rows to the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs only the tasks after the table.  The files go when the
    driver ends; ``drop_stored`` removes them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/lorelog/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Only for a table that no pending plan reads."""
    if path := getattr(df, "_stored_path", None):
        _remove(df.sparkSession, path)


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Equi-join of many rows with one row a class, when some classes hold a large part of the rows.

    ``weight`` is a column of ``classes``: the rows of the class.  At most HOT_SHARE classes have more than
    1/HOT_SHARE of the rows; those are broadcast (a proven bound), the rest meet by a shuffle.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot, cold = classes.filter(F.col(weight) > limit), classes.filter(F.col(weight) <= limit)
    near = rows.join(F.broadcast(hot), key, "inner")
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of the edges (a long, b long): rows (node, component), the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Each step is a map-side combined
    minimum and an equi-join; edges never meet in one task, and each round's edges are a stored table.
    Self-loops and repeated edges are allowed; nodes without an edge to another node don't appear.
    """
    state = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag
    )
    while True:
        before = _digest(state)
        if before[0] == 0:
            break
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, tag)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        after = stored(small, tag)
        done = _digest(after) == before
        drop_stored(state)
        drop_stored(large)
        state = after
        if done:
            break
    leaves = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
