"""Column functions, configuration and status."""

import pytest
from pyspark.sql import functions as F

from lorelog.functions import numbers, paths, people, text, times
from lorelog.model import Config, Scope, Status, UserError
from lorelog.operators import assisted, identities, interpret


def values(spark, rows, kind, f):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_rounding(spark):
    assert values(spark, [1.005, 2.5, -0.125], "double", lambda x: numbers.round_places(x, 2)) == [1.0, 2.5, -0.13]
    assert values(spark, [0.123456789, 123456.789, 0.0, -0.00012345678], "double", numbers.significant) == [0.123457, 123457.0, 0.0, -0.000123457]
    assert spark.range(1).select(numbers.ratio(F.lit(0), F.lit(0))).first()[0] is None


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.lock", ["a.lock", "x/y/b.lock"], ["lock", "a.lock/x"]),
        ("vendor/**", ["vendor/a", "vendor/a/b", "vendor"], ["x/vendor/a", "vendors/a"]),
        ("**/vendor/**", ["vendor/a", "x/y/vendor/b"], ["x/vendors/b"]),
        ("*.min.js", ["a.min.js"], ["x/a.min.js"]),
        ("src/{a,b}?.[ch]", ["src/a1.c", "src/bx.h"], ["src/a.c", "src/c1.c", "src/a1.o"]),
        ("**/*.generated.*", ["q.generated.go", "a/b.generated.x.y"], ["generated.go"]),
    ],
)
def test_globs(spark, glob, yes, no):
    assert all(values(spark, yes, "string", lambda x: x.rlike(paths.glob_regex(glob))))
    assert not any(values(spark, no, "string", lambda x: x.rlike(paths.glob_regex(glob))))


def test_attributes(spark):
    marks = "*.gen linguist-generated\nkept.gen -linguist-generated\n/top.txt linguist-generated\ndocs/ linguist-generated\n*.dat binary\nx.dat diff\n*.q !diff\n"
    got = values(spark, ["a/b.gen", "z/kept.gen", "top.txt", "s/top.txt", "docs/a/b", "yarn.lock", "main.go"], "string", lambda x: paths.is_excluded(x, attributes=marks))
    assert got == [True, False, True, False, True, True, False]
    assert values(spark, ["a.dat", "b/x.dat", "n.q", "m"], "string", lambda x: paths.binary_attribute(x, marks)) == [True, False, None, None]
    assert values(spark, [b"a\0b", b"ab\x10\x01", b"x" * 8000 + b"\0", b""], "binary", paths.has_nul) == [True, False, False, False]


def test_paths(spark):
    names = ["a/b/C.Test.js", ".gitignore", "x/.env.local", "Makefile", "a/b.", "plain"]
    assert values(spark, names, "string", paths.stem) == ["c", ".gitignore", ".env", "makefile", "b", "plain"]
    assert values(spark, names, "string", paths.extension) == ["js", "", "local", "", "", ""]
    assert values(spark, names, "string", lambda x: paths.directory(x, 1)) == ["a", None, "x", None, "a", None]
    assert values(spark, names, "string", lambda x: paths.directory(x, 2)) == ["a/b", None, None, None, None, None]


@pytest.mark.parametrize(
    ("subject", "kind", "conventional"),
    [
        ("feat(core)!: x", "feat", True), ("feat: ", "other", False), ("Feat: add it", "feat", False), ("fix crash", "fix", False), ("prefix it", "other", False),
        ('Revert "feat: x"', "revert", False), ("Merge pull request 3", "merge", False), ("update docs", "docs", False), ("hotfix", "fix", False), ("fixé bug", "fix", False),
        ("rename x", "refactor", False), ("release 3", "ci", False), ("compile it", "build", False), ("bump deps", "chore", False), ("hello", "other", False),
    ],
)
def test_messages(spark, subject, kind, conventional):
    df = spark.createDataFrame([(subject,)], "s string")
    s = F.col("s")
    row = df.select(text.is_conventional(s), F.when(text.is_conventional(s), text.conventional_type(s)).otherwise(text.keyword_class(s))).first()
    assert tuple(row) == (conventional, kind)


def test_message_marks(spark):
    assert values(spark, ["✨ x", "plain", "é", "🚀"], "string", text.has_emoji) == [True, False, False, True]
    assert values(spark, ["see #12", "ABC-3 x", "abc-3", "xABC-3", "#x"], "string", text.has_issue_reference) == [True, True, False, False, False]
    assert values(spark, ["fix typos", "typography", " Typo "], "string", text.is_typo_fix) == [True, False, True]
    assert values(spark, ["a\n\nb\nc", "a\nb", "a", "a\n \t\nb"], "string", text.body_of) == ["b\nc", "", "", "b"]


def test_people(spark):
    assert values(spark, [" Ada@Example.com "], "string", people.digest) == ["b5fc85e55755f9e0"]
    assert values(spark, ["12+ada@users.noreply.github.com", "7-bob@users.noreply.gitlab.com", "a@b.c"], "string", people.noreply_account) == ["ada", "bob", ""]
    assert values(spark, ["a@b@c", "@x", "none"], "string", people.local_part) == ["a@b", "", ""]
    df = spark.createDataFrame([("Dependabot[bot]", "x@y"), ("Ada", "gitlab-bot"), ("Eve", "eve@z")], "n string, a string")
    hit = lambda entry: [r[0] for r in df.select(people.matches_entry(F.col("n"), F.col("a"), entry)).collect()]
    assert hit("dependabot[bot]") == [True, False, False] and hit("gitlab-bot") == [False, True, False] and hit("EVE@z") == [False, False, True]


def test_candidates(spark):
    rows = [(1, "Ada Lovelace", "ada@x.org"), (2, "ada  lovelace", "other@y.org"), (3, "Zed", "9+ada@users.noreply.github.com"), (4, "Q", "ada@z.org"), (5, "R", "3-other@users.noreply.gitlab.com")]
    found = identities.evidence(spark.createDataFrame(rows, "id int, n string, e string"), "id", "n", ["e"])
    got = {tuple(r) for r in identities.merge_candidates(found).collect()}
    one = {(1, 2, "display_name"), (1, 4, "local_part"), (1, 3, "noreply"), (3, 4, "noreply"), (2, 5, "noreply")}
    assert got == one | {(b, a, s) for a, b, s in one}


def test_resolution(spark):
    config = Config(identities=(("ada@x.org", "Ada", ("lovelace@y.org",)),))
    commits = spark.createDataFrame([("a", "A.", "ADA@x.org"), ("b", "Lovelace", "lovelace@y.org"), ("c", "ci[bot]", "ada@x.org"), ("d", "Old", "old@z.org")], "hash string, author_name string, author_email string")
    mapped = identities.address_map(spark, [("old@z.org", "lovelace@y.org", "Map")], config)
    got = {r.hash: (r.identity_id, r.identity_name, r.author_excluded) for r in identities.resolve(commits, config, mapped).collect()}
    assert len({x[0] for x in got.values()}) == 1 and all(x[2] for x in got.values())  # one automation name marks the person
    assert got["d"][1] == got["b"][1] == "Ada"  # the configuration folds what the mail map gives


def test_assisted_marks(spark):
    rows = ["x\n\nCo-authored-by: assistant <a@b>", "x\n\nCo-authored-by: Ada <a@b>", "Co-authored-by: assistant <a@b>\n\nlast", "Generated with tool\n\nz", None]
    assert values(spark, rows, "string", assisted.tool_of) == ["assistant", None, None, "generated", None]


def test_config():
    merged, warnings = Config().merged({"exclude_paths": ["x/**"], "exclude_authors": [], "nonsense": 1, "recency_window_days": 7})
    assert merged.exclude_paths[-1] == "x/**" and len(merged.exclude_paths) == 42 and merged.exclude_authors == () and warnings == ["unknown key nonsense"]
    assert merged.digest() != Config().digest() == Config().digest()
    with pytest.raises(UserError):
        Config(cardinality_limits=(("identities", 5),))
    with pytest.raises(UserError):
        Config(date_source="other")


def test_scope_and_status(spark):
    with pytest.raises(UserError):
        Scope(frozenset({"a"})).check({"b"})
    with pytest.raises(UserError):
        Scope(frozenset({"a"})).check({"a"}, ["a", "a"])
    df = spark.createDataFrame([("a", 2024), (None, 2024), ("b", 2025)], "id string, year int")
    assert df.filter(Scope().includes(F.col("id"), F.col("year"))).count() == 3
    assert df.filter(Scope(frozenset({"a", "b"})).includes(F.col("id"), F.col("year"))).count() == 2
    assert df.filter(Scope(year=2024).includes(F.col("id"), F.col("year"))).count() == 2
    status = Status().degrade("shallow_clone", "low").degrade("empty_population")
    assert (status.status, status.reasons, status.confidence) == ("degraded", ("empty_population", "shallow_clone"), "low")


def test_conditions():
    assert interpret.condition_sql("x", "0.8..3.0") == "(x >= 0.8 AND x <= 3.0)" and interpret.condition_sql("x", "==1") == "x = 1" and interpret.condition_sql("x", "true") == "x"
    with pytest.raises(ValueError):
        interpret.condition_sql("x", "~3")
    for rules in (interpret.PERSON, interpret.REPOSITORY):
        assert len({n for n, _ in rules}) == len(rules) and rules[-1][1] == {} and all(when for _, when in rules[:-1])
    assert (len(interpret.PERSON), len(interpret.REPOSITORY), len(interpret.BADGES)) == (24, 17, 40)


def test_archetypes_in_order(spark):
    axes = spark.createDataFrame([(1, 0.4, 0.9, 1.0), (2, 0.1, 0.3, 1.0), (3, 0.0, 0.0, 6.0), (4, 0.0, 0.0, 1.0)], "id int, nocturnality double, earliness double, cadence double")
    assert [r[0] for r in axes.select(interpret.archetype(axes, interpret.PERSON)).collect()] == ["night-watchman", "dawn-patrol", "sprinter", "steady-hand"]


def test_local_time(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-01 23:30:00' AS t, 60 AS off UNION ALL SELECT timestamp_ntz'2025-01-01 00:30:00', -90")
    assert [str(r[0]) for r in df.select(times.local_time(F.col("t"), F.col("off"))).collect()] == ["2025-01-02 00:30:00", "2024-12-31 23:00:00"]
