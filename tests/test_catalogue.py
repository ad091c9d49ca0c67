"""Every catalogue query against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from lorelog.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, DATA)
    want = db.sql(catalogue.SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(want.columns, want.fetchall())


def test_only_the_alignment_has_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"replay_alignment"}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_replay_alignment(spark, db):
    """Each document against the one before it of its source: as many lines match as a longest common subsequence has."""
    texts = db.sql("SELECT source, doc_id, coalesce(text, '') FROM documents ORDER BY source, doc_id").fetchall()
    want, before = set(), {}
    for source, doc_id, text in texts:
        old, new = (x.encode().split(b"\n") for x in (before.get(source, ""), text))
        old, new = ([*(x + b"\n" for x in lines[:-1]), *([lines[-1]] if lines[-1] else [])] for lines in (old, new))
        n = longest_common(old, new)
        want.add((source, doc_id, n, len(new) - n, len(old) - n))
        before[source] = text
    got = catalogue.QUERIES["replay_alignment"](spark, DATA).select("source", "doc_id", "matched", "added", "removed")
    assert {tuple(r) for r in got.collect()} == want and len(want) == len(texts)


@pytest.mark.parametrize("name", ["temporal_people", "coupling_pairs", "identity_listing", "churn_files"])
def test_results_do_not_depend_on_partitions(spark, name):
    want = rows_of([], []) or None
    for n, aqe in (("1", "true"), ("2", "false"), ("13", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            found = catalogue.QUERIES[name](spark, DATA)
            got = rows_of(found.columns, [tuple(r) for r in found.collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert want is None or got == want
        want = got


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
