"""The log source over a small repository, the stored history, the report and the streams."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lorelog import report
from lorelog.model import Config, UserError
from lorelog.operators import annotate, temporal
from lorelog.plans import bindings
from lorelog.sources import gitlog, history
from lorelog.streaming import cells


def run(path, *args, when=None, who=("Ada", "ada@example.com")):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": who[0], "GIT_AUTHOR_EMAIL": who[1], "GIT_COMMITTER_NAME": who[0], "GIT_COMMITTER_EMAIL": who[1]}
    if when:
        env |= {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    path = tmp_path_factory.mktemp("clone")
    run(path, "init", "-q", "-b", "main")

    def commit(name, text, subject, when, who=("Ada", "ada@example.com")):
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(text)
        run(path, "add", "-A")
        run(path, "commit", "-q", "-m", subject, when=when, who=who)

    commit("src/a b\n.go", b"1\n2\n3\n4\n5\n6\n", "feat: first\n\nwith a body", "2025-01-03T23:30:00+01:00")
    commit("yarn.lock", b"x\n" * 50, "bump deps", "2025-01-04T01:00:00-05:00", ("Bob", "bob@example.com"))
    run(path, "checkout", "-q", "-b", "side")
    commit("src/bin", b"\0\1\2", "add binary", "2025-01-05T10:00:00+00:00", ("Bob", "bob@example.com"))
    run(path, "checkout", "-q", "main")
    commit("src/a b\n.go", b"1\n2\n3\n4\n5\n6\n7\n", "fix: more", "2025-01-06T10:00:00+00:00")
    run(path, "merge", "-q", "--no-ff", "-m", "Merge branch side", "side", when="2025-01-07T10:00:00+00:00")
    run(path, "mv", "src/a b\n.go", "src/c.go")
    run(path, "commit", "-q", "-m", "rename it", when="2025-01-08T10:00:00+00:00")
    commit("src/d.go", b"q\n", "x", "2025-01-09T10:00:00+00:00", ("ci[bot]", "ci@example.com"))
    return str(path)


def test_log(spark, clone):
    rows = {r.subject: r for r in gitlog.read_history(spark, clone).filter("diff_no = 0").collect()}
    assert len(rows) == 7 and [rows[s].seq for s in ("x", "feat: first")] == [0, 6]
    first = rows["feat: first"]
    assert (first.body.strip(), first.author_off_min, str(first.author_ts)) == ("with a body", 60, "2025-01-03 22:30:00")
    assert [(f.path, f.added, f.deleted, f.is_binary, f.old_blob) for f in first.files] == [("src/a b\n.go", 6, 0, False, None)]
    assert [(f.path, f.is_binary) for f in rows["add binary"].files] == [("src/bin", True)]
    assert [(f.path, f.previous_path) for f in rows["rename it"].files] == [("src/c.go", "src/a b\n.go")]
    assert rows["Merge branch side"].is_merge and len(rows["Merge branch side"].parents) == 2


def test_shards_join_up(spark, clone, monkeypatch):
    assert gitlog.shards(4999, 8) == [(0, 4999)] and len(gitlog.shards(171_000, 64)) == 16 and gitlog.shards(5000, 64)[-1] == (4500, 5000)
    want = sorted((r.hash, r.seq, r.diff_no) for r in gitlog.read_history(spark, clone).collect())
    reader = gitlog.GitLogReader({"path": clone})
    hashes = [h for p in reader.partitions() for h in p.hashes]
    got = [x for k in range(0, len(hashes), 2) for x in reader.read(gitlog.Shard(hashes[k : k + 2], k))]
    assert sorted((x[0], x[1], x[14]) for x in got) == want


def test_bad_records_are_marked():
    header = "\x1e" + "\x1f".join(["h", "t", "", "n", "e", "e", "2025-01-01T00:00:00+00:00", "2025-01-01T00:00:00+00:00", "s", "", ""])
    good = ":000000 100644 " + "0" * 40 + " " + "a" * 40 + " A\0p\0" + "1\t0\tp\0"
    wrong = ":000000 100644 " + "0" * 40 + " " + "a" * 40 + " A\0p\0" + "1\t0\tq\0"
    assert [x[-1] for x in gitlog.parse((header + "\0" + good + header.replace("h", "i", 1) + "\0" + wrong).encode(), 0)] == [False, True]


def test_preflight(clone, tmp_path):
    info = gitlog.preflight(clone)
    assert info["default_branch"] == "main" and not info["is_shallow"]
    for path, reason in ((str(tmp_path / "none"), "path_not_found"), (str(tmp_path), "not_a_repository")):
        with pytest.raises(UserError) as e:
            gitlog.preflight(path)
        assert e.value.reason == reason
    run(tmp_path, "init", "-q")
    with pytest.raises(UserError) as e:
        gitlog.preflight(str(tmp_path))
    assert e.value.reason == "empty_repository"


def test_tree_and_blobs(spark, clone):
    tree = gitlog.tree_at(spark, clone)
    assert {r.path for r in tree.collect()} == {"src/c.go", "src/bin", "src/d.go", "yarn.lock"}
    found = {r.oid: r for r in gitlog.blobs(tree.select(F.col("blob").alias("oid")), clone, limit=20, sniffed=4).collect()}
    by_path = {r.path: found[r.blob] for r in tree.collect()}
    assert bytes(by_path["src/d.go"].content) == b"q\n" and by_path["yarn.lock"].oversized and bytes(by_path["yarn.lock"].content) == b"x\nx\n"


def test_report(spark, clone, tmp_path):
    config = Config()
    commits = gitlog.read_history(spark, clone).filter("diff_no = 0")
    annotated = annotate.annotate(commits, config)
    rows = {r.subject: r for r in annotated.collect()}
    assert rows["x"].excluded and rows["Merge branch side"].excluded and rows["bump deps"].effective_lines == 0 and rows["feat: first"].effective_lines == 6
    assert str(rows["feat: first"].active_date) == "2025-01-03" and str(rows["bump deps"].active_date) == "2025-01-04"
    changes = annotate.file_changes(annotated, config)
    head = gitlog.tree_at(spark, clone).select("path", F.lit(True).alias("text"))
    built = report.build(annotated, changes, head, config, gitlog.preflight(clone))
    t = built["families"]["temporal"]["metrics"]
    assert t["commits"] == 5 and sum(t["hour_histogram"]) == 5 and built["families"]["static_analysis"]["status"] == "skipped"
    assert built["families"]["commit_size"]["metrics"]["largest_commit"]["lines"] == 6
    assert [i["display_name"] for i in built["identities"]] == ["Ada", "Bob"]
    history.write_json(built, str(tmp_path / "r.json"))
    history.write_html({"x": "</script>& "}, str(tmp_path / "r.html"))
    assert json.loads((tmp_path / "r.json").read_text())["document_version"] == "2.0" and (tmp_path / "r.html").read_text().count("</script>") == 1
    assert "ada@example.com" not in (tmp_path / "r.json").read_text()
    summary = annotate.summary(annotated).first()
    assert (summary.commits, summary.analysed, summary.merges, summary.excluded_authors) == (7, 5, 1, 1)


def test_stored_history(spark, clone, tmp_path):
    commits = gitlog.read_history(spark, clone)
    history.write_history(commits, str(tmp_path / "h"), {"name": "x"})
    back, meta = history.read_history(spark, str(tmp_path / "h"))
    assert back.count() == commits.count() and meta["schema_version"] == 5
    spark.createDataFrame([(4, "{}")], "schema_version int, meta string").write.mode("overwrite").parquet(str(tmp_path / "h/meta"))
    with pytest.raises(ValueError):
        history.read_history(spark, str(tmp_path / "h"))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    commits = bindings.event_commits(spark, "/root/testdata/sf0.001")
    commits.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(commits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(cells.day_cells(stream, "id", "local", "400 days"), "day_cells", "complete")
    want = temporal.cells(temporal.moments(commits, "id", "local")).select("id", "day", "hour", "commits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    touches = drain(cells.rolling_touches(stream, "kind", "local", late="400 days"), "touches", "complete")
    assert touches.agg(F.max("touches")).first()[0] <= commits.count()
    bouts = drain(cells.sessions(stream, "id", "local", late="400 days"), "bouts", "complete")
    assert bouts.agg(F.sum("commits")).first()[0] == commits.count()


def test_command_line(spark, clone, tmp_path, capsys):
    from lorelog.__main__ import main

    out = tmp_path / "out.json"
    assert main([clone, "--output", str(out), "--html", str(tmp_path / "o.html"), "--quiet"], spark) == 0
    built = json.loads(out.read_text())
    assert built["families"]["files"]["metrics"]["tracked_text_file_count"] == 3 and built["repository"]["default_branch"] == "main"
    assert built["metadata"]["tree_differences"] == []
    owned = built["families"]["ownership"]["metrics"]
    blame = {}
    for path in ("src/c.go", "src/d.go"):
        said = gitlog.git(clone, "blame", "--line-porcelain", "HEAD", "--", path).decode()
        for line in said.splitlines():
            if line.startswith("author "):
                blame[line[7:]] = blame.get(line[7:], 0) + 1
    names = {i["id"]: i["display_name"] for i in built["identities"] if "id" in i}
    assert {names[o["owner_id"]]: o["lines"] for o in owned["owners"]} == {k: v for k, v in blame.items() if k != "ci[bot]"} and owned["line_count"] == sum(blame.values())
    work = built["families"]["worktype"]["metrics"]["repository_shares"]
    assert (work["classified_line_count"], work["new_work"]) == (7, 1.0)
    assert built["families"]["ai_archaeology"]["metrics"]["assisted_commit_count"] == 0
    assert {h["path"] for h in built["families"]["hotspot"]["metrics"]["hotspots"]} <= {"src/c.go", "src/d.go"}
    assert {p["id"] for p in built["interpretation"]["people"]} == set(names) and built["interpretation"]["repository"]
    assert "static" not in {b["badge"] for b in built["interpretation"]["skipped_badges"]}
    assert main([str(tmp_path / "none")], spark) == 2 and "path_not_found" in capsys.readouterr().err
    assert main([clone, "--year", "2025", "--quiet"], spark) == 2 and "year_below_threshold" in capsys.readouterr().err
    bad = tmp_path / "c.json"
    bad.write_text("[")
    assert main([clone, "--config", str(bad)], spark) == 2


def test_configuration_is_shown_without_people():
    config = Config(identities=(("ada@example.com", "Ada", ("a@old.example",)),), exclude_authors=(*Config().exclude_authors, "Bob", "eve@example.com"))
    text = json.dumps(config.shown())
    assert "@" not in text.replace("@" * 2, "") and "Ada" in text and "Bob" in text
    hidden = json.dumps(Config(identities=config.identities, exclude_authors=config.exclude_authors, anonymize=True).shown())
    assert not any(x in hidden for x in ("Ada", "Bob", "ada@", "eve@")) and hidden.count("ref:") == 5


def test_log_comes_in_pieces(clone, monkeypatch):
    reader = gitlog.GitLogReader({"path": clone})
    whole = [row for p in reader.partitions() for row in reader.read(p)]
    monkeypatch.setattr(gitlog, "CHUNK", 64)
    assert [row for p in reader.partitions() for row in reader.read(p)] == whole
    assert sum(row[11] for row in whole) == 2  # the merge has a diff against either parent


def test_odd_dates_mark_the_record():
    header = "\x1e" + "\x1f".join(["h", "t", "", "n", "e", "e", "when?", "2025-01-01T00:00:00+00:00", "s", "", ""])
    change = ":000000 100644 " + "0" * 40 + " " + "a" * 40 + " A\0p\0" + "1\t0\tp\0"
    good = header.replace("h", "i", 1).replace("when?", "2025-01-01T00:00:00+00:00")
    assert [x[-1] for x in gitlog.parse((header + "\0" + change + good + "\0" + change).encode(), 0)] == [True, False]


def test_bounds_are_instants(clone):
    assert gitlog.resolved_bounds(clone, "2025-01-06T00:00:00+00:00") == {"since": 1736121600}
    assert len([h for p in gitlog.GitLogReader({"path": clone, "since": "2025-01-06T00:00:00+00:00"}).partitions() for h in p.hashes]) == 4


def test_replay_finds_edits_of_a_clone(spark, tmp_path):
    """Every line event of a small history, listed by hand: a rename, an edit of another's line, a merge, a deletion."""
    from lorelog.operators import replay, steps

    ada, bob = ("Ada", "ada@example.com"), ("Bob", "bob@example.com")
    run(tmp_path, "init", "-q", "-b", "main")

    def commit(files, day, who, *moves):
        for old, new in moves:
            run(tmp_path, "mv", old, new)
        for name, content in files.items():
            if content is None:
                run(tmp_path, "rm", "-q", name)
            else:
                (tmp_path / name).write_text(content)
        run(tmp_path, "add", "-A")
        run(tmp_path, "commit", "-q", "-m", f"day {day}", when=f"2025-01-{day:02}T12:00:00+00:00", who=who)

    base = "".join(f"line {k}\n" for k in range(10))
    commit({"f": base, "g": "a\nb\n"}, 1, ada)
    run(tmp_path, "checkout", "-q", "-b", "side")
    commit({"g": "a\nb\nc\n"}, 3, bob)
    run(tmp_path, "checkout", "-q", "main")
    commit({"h": base.replace("line 4", "other 4")}, 5, bob, ("f", "h"))
    run(tmp_path, "merge", "-q", "--no-ff", "-m", "merge", "side", when="2025-01-06T12:00:00+00:00", who=ada)
    commit({"g": None}, 9, ada)
    config = Config(count_merges=True)
    log = gitlog.read_history(spark, str(tmp_path))
    annotated = annotate.annotate(log.filter("diff_no = 0"), config)
    contents = gitlog.blobs(steps.touched_blobs(log), str(tmp_path))
    head = gitlog.preflight(str(tmp_path))["head_commit"]
    out = replay.replay(*steps.steps(log, annotated, contents, head), head)
    name = {r.identity_id: r.identity_name for r in annotated.collect()}
    events = {(r.kind, name[r.editor], name.get(r.owner), r.age_days, r.path, r.lines) for r in replay.edit_events(out).collect()}
    assert events == {
        ("addition", "Ada", None, None, "f", 10), ("addition", "Ada", None, None, "g", 2), ("addition", "Bob", None, None, "g", 1),
        ("replacement", "Bob", "Ada", 4, "h", 1), ("deletion", "Ada", "Ada", 8, "g", 2), ("deletion", "Ada", "Bob", 6, "g", 1),
    }
    assert steps.check_tree(out, gitlog.tree_at(spark, str(tmp_path))).count() == 0
    assert [(r.path, r.reason) for r in steps.check_tree(out, gitlog.tree_at(spark, str(tmp_path)).filter("path <> 'h'")).collect()] == [("h", "not in the tree")]
    owners = {r.line_no: name[r.owner_id] for r in replay.ownership_lines(out).collect()}
    assert owners == {k: "Bob" if k == 4 else "Ada" for k in range(10)}
