"""The shared folder, and joins and components with hot keys."""

import pytest
from pyspark.sql import functions as F

from lorelog import storage


class Settings:
    def __init__(self, **values):
        self.values = values
        self.conf = self

    def get(self, name, default=None):
        return self.values.get(name, default)


def test_a_cluster_needs_a_shared_folder():
    named = {"spark.checkpoint.dir": "hdfs://x/y"}
    assert storage.shared_root(Settings(**named)) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert storage.shared_root(Settings(**{"spark.master": master})).startswith("file://")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077", None):
        with pytest.raises(ValueError):
            storage.shared_root(Settings(**{"spark.master": master}))


def test_stored_tables_lie_in_the_shared_folder_and_go(spark):
    import os

    table = storage.stored(spark.range(10), "test")
    path = table._stored_path.removeprefix("file://")
    assert table._stored_path.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.exists(path) and table.count() == 10
    storage.drop_stored(table)
    assert not os.path.exists(path)


def test_hot_classes_are_joined_apart(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = storage.join_by_class(rows, classes, "k", "n", 6000)
    assert found.count() == 6000 and found.filter("k = 0").agg(F.min("n"), F.count("id")).first() == (2000, 2000)


def test_a_hub_has_one_component(spark):
    edges = spark.range(1, 3000).select(F.lit(0).alias("a"), F.col("id").alias("b")).unionAll(spark.range(5000, 5010).select("id", F.col("id") + 1))
    found = storage.components(edges.toDF("a", "b"))
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 3000), (5000, 11)}
