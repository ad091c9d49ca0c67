"""Alignment, ownership replay and the commit graph."""

import random

import pytest

from lorelog.operators import alignment, dag, replay


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a = [b"%d\n" % rng.randrange(6) for _ in range(rng.randrange(30))]
    b = [b"%d\n" % rng.randrange(6) for _ in range(rng.randrange(30))]
    got = alignment.align(a, b)
    pairs = [(i, j) for j, i in enumerate(got) if i >= 0]
    assert all(a[i] == b[j] for i, j in pairs) and [i for i, _ in pairs] == sorted({i for i, _ in pairs})
    assert len(pairs) == brute_lcs(a, b)


def test_ties_pass_over_old_lines_first():
    assert alignment.align([b"x", b"a", b"b", b"y"], [b"p", b"b", b"a", b"q"]) == [-1, 2, -1, -1]


def test_large_gaps_use_unique_lines(monkeypatch):
    monkeypatch.setattr(alignment, "EXACT_CELLS", 4)
    a = [b"r", b"u1", b"r", b"r", b"u2", b"r", b"z"]
    b = [b"n", b"u1", b"r", b"m", b"u2", b"r", b"k"]
    got = alignment.align(a, b)
    assert got[1] == 1 and got[4] == 4 and got[0] == -1 and got[6] == -1
    assert alignment.align([b"a", b"a", b"a", b"b"] * 3, [b"b", b"c", b"a"] * 4)[0] == -1  # no unique line, no match inside


def test_split_lines():
    assert alignment.split_lines(b"a\nb") == [b"a\n", b"b"] and alignment.split_lines(b"a\n") == [b"a\n"] and alignment.split_lines(b"") == [] and alignment.split_lines(b"\n\n") == [b"\n", b"\n"]


def test_blocks():
    got = [(list(r), a) for r, a in replay.changed_blocks([-1, 0, -1, -1, 3], 5)]
    assert got == [([], [0]), ([1, 2], [2, 3]), ([4], [])]


HISTORY = [
    # hash, parents, merge, author, day, [(path, previous, blob content or None)]
    ("c1", [], False, "ada", 0, [("f", None, b"1\n2\n3\n"), ("g", None, b"a\nb\n")]),
    ("c2", ["c1"], False, "bob", 2, [("f", None, b"1\nX\n3\n4\n")]),
    ("c3", ["c1"], False, "eve", 3, [("g", None, b"a\nb\nc\n")]),
    ("m1", ["c2", "c3"], True, "ada", 5, [("g", None, b"a\nb\nc\n")]),
    ("c4", ["m1"], False, "ada", 40, [("h", "f", b"1\nX\n4\n")]),
    ("c5", ["m1"], False, "bob", 41, [("g", None, b"a\nQ\nc\n")]),
    ("m2", ["c4", "c5"], True, "eve", 42, [("g", None, b"a\nQ\nown\nc\n")]),
    ("c6", ["m2"], False, "bob", 43, [("g", None, None), ("bin", None, b"\0\1")]),
    ("c7", ["c6"], False, "ada", 44, [("bin", None, b"text\n"), ("z", None, b"q\n")]),
]


@pytest.fixture(scope="module")
def history(spark):
    blob, steps = {}, []
    at = {}
    for position, (h, parents, merge, author, day, changed) in enumerate(HISTORY):
        before = [dict(at[p]) for p in parents] or [{}]
        now = dict(before[0])
        for path, previous, content in changed:
            name = f"b{len(blob)}"
            same = [v for v in (b.get(path) for b in before) if v is not None and content is not None and blob.get(v) == content]
            new = None if content is None else same[0] if same else name
            if new == name:
                blob[name] = content
            versions = [(path, b.get(path)) for b in before] if merge else None
            steps.append((h, position, merge, author, day, 2025, True, path, previous, new, versions, content, False, None))
            now.pop(previous, None)
            now.pop(path, None)
            if new:
                now[path] = new
        at[h] = now
    graph = spark.createDataFrame([(h, p) for h, p, *_ in HISTORY], "hash string, parents array<string>")
    return spark.createDataFrame(steps, replay.STEP), graph


def test_events_and_owners(history):
    steps, graph = history
    out = replay.replay(steps, graph, "c7")
    events = {(r.commit_hash, r.kind, r.editor, r.owner, r.age_days, r.path): r.lines for r in replay.edit_events(out).collect()}
    assert events == {
        ("c1", "addition", "ada", None, None, "f"): 3, ("c1", "addition", "ada", None, None, "g"): 2,
        ("c2", "replacement", "bob", "ada", 2, "f"): 1, ("c2", "addition", "bob", None, None, "f"): 1,
        ("c3", "addition", "eve", None, None, "g"): 1,
        ("c4", "deletion", "ada", "ada", 40, "h"): 1,
        ("c5", "replacement", "bob", "ada", 41, "g"): 1,
        ("m2", "addition", "eve", None, None, "g"): 1,
        ("c6", "deletion", "bob", "ada", 43, "g"): 1, ("c6", "deletion", "bob", "bob", 2, "g"): 1, ("c6", "deletion", "bob", "eve", 1, "g"): 1, ("c6", "deletion", "bob", "eve", 40, "g"): 1,
        ("c7", "addition", "ada", None, None, "z"): 1,
    }
    lines = {(r.path, r.line_no): (r.owner_id, r.commit_hash) for r in replay.ownership_lines(out).collect()}
    assert lines == {("h", 0): ("ada", "c1"), ("h", 1): ("bob", "c2"), ("h", 2): ("bob", "c2"), ("bin", 0): ("ada", "c7"), ("z", 0): ("ada", "c7")}


def test_components_equal_one_walk(history):
    steps, graph = history
    rows = lambda df: sorted(map(str, df.drop("limited").collect()))
    assert rows(replay.replay(steps, graph, "c7")) == rows(replay.replay(steps, graph, "c7", one_group=True))


def test_many_renames_are_linked_by_joins(history, monkeypatch):
    steps, graph = history
    want = sorted(map(str, replay.replay(steps, graph, "c7").drop("limited").collect()))
    monkeypatch.setattr(replay, "DRIVER_LINKS", 0)
    assert sorted(map(str, replay.replay(steps, graph, "c7").drop("limited").collect())) == want


def test_graph(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "c")], "child string, parent string")
    assert {r.node for r in dag.ancestors(edges, "d").collect()} == {"a", "b", "c", "d"}
    order = {r.node: (r.level, r.position) for r in dag.levels(edges).collect()}
    assert order == {"a": (0, 0), "b": (1, 1), "c": (1, 2), "d": (2, 3), "x": (2, 4)}
    with pytest.raises(ValueError):
        dag.topological([("a", "b"), ("b", "a")])


def test_joins_walk_a_graph_too_large_for_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(dag, "DRIVER_EDGES", 2)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "c")], "child string, parent string")
    assert {r.node for r in dag.ancestors(edges, "d").collect()} == {"a", "b", "c", "d"}


def test_joins_order_a_graph_too_large_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr(dag, "DRIVER_EDGES", 2)
    pairs = [(1, 9), (9, 5), (2, 9), (3, 2), (3, 1), (7, 5), (8, 3), (4, 8), (6, 4), (10, 6), (0, 10)]
    found = dag.levels(spark.createDataFrame(pairs, "child long, parent long")).collect()
    assert [(r.node, r.level) for r in sorted(found, key=lambda r: r.position)] == dag.topological(pairs)
    assert sorted(r.position for r in found) == list(range(len(found)))
    with pytest.raises(ValueError):
        dag.levels(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "child long, parent long"))


def test_merge_diffs_find_their_parents(spark):
    commits = spark.createDataFrame([("m", "t1", ["p", "q", "r"]), ("p", "t0", []), ("q", "t1", []), ("r", "t2", [])], "hash string, tree string, parents array<string>")
    assert {tuple(r) for r in dag.merge_diff_parents(commits).collect()} == {("m", 0, 0), ("m", 1, 2)}
    diffs = spark.createDataFrame([("m", 0, "f", None, "o0", "n"), ("m", 2, "f", "old", "o2", "n"), ("m", 2, "other", None, "x", "y")], "hash string, parent_no int, path string, previous_path string, old_blob string, new_blob string")
    row = dag.merge_changes(commits, diffs).collect()
    assert [(r.path, r.new_blob, [tuple(v) for v in r.parents]) for r in row] == [("f", "n", [("f", "o0"), ("f", "n"), ("old", "o2")])]
