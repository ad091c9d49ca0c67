"""Commit logs given by formulas, with the figures known for them."""

import pytest
from pyspark.sql import functions as F

from lorelog.functions import times
from lorelog.operators import commit_size, coupling, files, hotspot, temporal

BASE = 1759276800  # 2025-10-01T00:00:00Z


def log(spark, rows):
    df = spark.createDataFrame(rows, "hash long, epoch long, off int, id string, files array<struct<path:string,added:bigint,deleted:bigint>>")
    return df.withColumn("local", times.local_time(F.timestamp_seconds("epoch").cast("timestamp_ntz"), F.col("off")))


@pytest.fixture(scope="module")
def basic(spark):
    hours, rows = (9, 14, 23, 2, 17, 11, 20, 4), []
    for i in range(50):
        changed = [("src/main.go", 1, 0)] + [("docs/notes.md", 1, 0)] * (i % 3 == 0) + [("src/util.go", 1, 0)] * (i % 5 == 0)
        rows.append((i, BASE + 3 * i * 86400 + hours[i % 8] * 3600, (0, 180, -300)[i % 3], f"p{i % 4}", changed))
    return log(spark, rows)


@pytest.fixture(scope="module")
def large(spark):
    rows, revision = [], {}

    def change(k):
        revision[k] = r = revision.get(k, 0) + 1
        d = sum(r % x == 0 for x in range(1, 31))
        return (f"pkg{k % 8}/file{k}.go", 30, 0) if r == 1 else (f"pkg{k % 8}/file{k}.go", d, d)

    for i in range(1, 20_001):
        ks = [7 * i % 40] + ([(3 * i + 1) % 40] if i % 10 == 0 else [])
        rows.append((i, BASE - (20_000 - i) * 21_600, (0, 330, -420)[i % 3], f"p{i % 12}", [change(k) for k in dict.fromkeys(ks)]))
    return log(spark, rows)


def changes(df):
    return df.select(F.col("hash").alias("commit"), F.col("id"), F.to_date("local").alias("date"), F.col("epoch").alias("at"), F.inline("files"))


def test_basic(basic):
    row = temporal.profile(temporal.moments(basic, "id", "local"), places=4).first()
    assert (row.commits, row.night_ratio, row.weekend_ratio, row.longest_streak_days, row.elapsed_silence_days) == (50, 0.32, 0.3, 2, 3)
    sized = commit_size.sizes(changes(basic), "commit", "path", F.col("added"), F.col("deleted"), keep=("date",))
    size = commit_size.profile(sized, 10_000).first()
    assert (size.mean_lines, size.median_lines) == (1.5, 1.0)
    got = {(r.a, r.b, r.support, r.confidence) for r in coupling.pairs(coupling.qualifying(changes(basic))).collect()}
    assert got == {("docs/notes.md", "src/main.go", 17, 1.0), ("src/main.go", "src/util.go", 10, 1.0)}
    churned = {r.path: (r.window_commits, r.total_commits) for r in hotspot.churn(changes(basic)).collect()}
    assert churned["src/main.go"] == (11, 50)
    head = changes(basic).select("path").distinct()
    assert [(r.path, r.commits, r.removed) for r in files.most_modified(changes(basic), head).collect()] == [("src/main.go", 50, False), ("docs/notes.md", 17, False), ("src/util.go", 10, False)]


def test_large(large):
    row = temporal.profile(temporal.moments(large, "id", "local"), places=4).first()
    assert (row.night_ratio, row.weekend_ratio, row.friday_evening_count, row.longest_streak_days) == (0.4167, 0.2856, 1190, 5000)
    sized = commit_size.sizes(changes(large), "commit", "path", F.col("added"), F.col("deleted"), keep=("date",))
    size = commit_size.profile(sized, 10_000).first()
    assert (size.mean_lines, size.median_lines) == (8.8, 6.0)


def test_a_scope_is_the_sum_of_its_cells(basic):
    m = temporal.moments(basic, "id", "local")
    people = {r.id: r for r in temporal.profile(m, ["id"]).collect()}
    whole = temporal.profile(m).first()
    assert sum(r.commits for r in people.values()) == whole.commits
    merged = temporal.profile(m.withColumn("id", F.lit("one")), ["id"]).first().asDict()
    assert {k: v for k, v in merged.items() if k != "id"} == whole.asDict()
    year = temporal.profile(m.filter("year = 2025")).first()
    assert year.commits == m.filter("year = 2025").count() < 50


def test_nothing_is_absent_not_zero(basic):
    row = temporal.profile(temporal.moments(basic.limit(0), "id", "local")).first()
    assert row.commits == 0 and row.night_ratio is None and row.busiest_day is None and row.regularity is None
    assert commit_size.profile(commit_size.sizes(changes(basic.limit(0)), "commit", "path", F.col("added"), F.col("deleted")), 10).first().mean_lines is None


def test_wide_commits_make_no_pairs(spark):
    wide = [(c, f"f{i}") for c in range(6) for i in range(51)]
    narrow = [(100 + c, p) for c in range(5) for p in ("a/x.go", "b/X.test.go", "a/x.go")]
    got = coupling.pairs(coupling.qualifying(spark.createDataFrame(wide + narrow, "commit int, path string"))).collect()
    assert [(r.a, r.b, r.support, r.expected) for r in got] == [("a/x.go", "b/X.test.go", 5, True)]


def test_graph_stops_at_its_bounds(spark):
    rows = [(f"a{i}", f"b{i}", 100 - i, 1.0, False) for i in range(90)]
    listed = spark.createDataFrame(rows, "a string, b string, support long, confidence double, expected boolean")
    assert coupling.graph(listed).count() == 75 and coupling.graph(listed, edges=10).count() == 10


def test_complexity(spark):
    lines = [("f", i, t) for i, t in enumerate(["a", "    b", "        c", "", "    d", "\te"])]
    row = hotspot.complexity(spark.createDataFrame(lines, "path string, line_no int, text string")).first()
    assert row.lines == 5 and abs(row.complexity_proxy - (0 + 1 + 2 + 1 + 1) / 5 * 2.321928094887362) < 1e-12
