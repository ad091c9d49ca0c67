"""The stored history and the report files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.model import HISTORY_VERSION


def write_history(commits: DataFrame, path: str, meta: dict) -> None:
    """commits/ by year, which prunes year scopes, and a one-row meta/ with the schema version."""
    commits.withColumn("year", F.year("author_ts")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/commits")
    row = {"schema_version": HISTORY_VERSION, **meta}
    spark = commits.sparkSession
    spark.createDataFrame([(HISTORY_VERSION, json.dumps(row, sort_keys=True))], "schema_version int, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    row = spark.read.parquet(f"{path}/meta").first()
    if row["schema_version"] != HISTORY_VERSION:
        raise ValueError(f"the history has schema version {row['schema_version']}, this reads {HISTORY_VERSION}")
    return spark.read.parquet(f"{path}/commits"), json.loads(row["meta"])


def write_json(report: dict, path: str) -> None:
    """Two-space indent, keys in their given order; the file appears whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)
        f.write("\n")
    os.replace(name, path)


def write_html(report: dict, path: str, title: str = "Report") -> None:
    """A page with the report inlined; characters that could end the script are escaped."""
    text = json.dumps(report, ensure_ascii=False, default=str)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    page = f"<!doctype html><meta charset=utf-8><title>{title}</title><pre id=view></pre><script>const report = {text};document.getElementById('view').textContent = JSON.stringify(report, null, 2);</script>\n"
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(page)
    os.replace(name, path)
