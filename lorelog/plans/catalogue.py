"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.functions import paths, people, text
from lorelog.functions.numbers import ratio, significant
from lorelog.model import LIMITS, Scope
from lorelog.operators import assisted, commit_size, coupling, dag, files, hotspot, identities, interpret, messages, ownership, replay, temporal, worktype
from lorelog.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def sig(x: str) -> str:
    """Six significant digits in SQL."""
    scale = f"pow(10.0, 5.0 - floor(log10(abs({x}))))"
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE round(({x}) * {scale}) / {scale} END)"


def share(part: str, whole: str) -> str:
    return sig(f"(CAST({part} AS DOUBLE) / CAST(nullif({whole}, 0) AS DOUBLE))")


def one_place(x: str) -> str:
    return f"round(({x}) * 10.0) / 10.0"


# --- temporal -----------------------------------------------------------------------------------------------


def _moments(spark, sf_dir, keep=()):
    return temporal.moments(b.event_commits(spark, sf_dir), "id", "local", keep)


def profile_sql(group: bool, source: str = "m") -> str:
    g, on = ("id, ", "id") if group else ("", "one")
    part = "PARTITION BY id " if group else ""
    head = "id" if group else "1 AS one"
    by = "GROUP BY id" if group else ""
    extra = "id, " if group else ""
    return f"""{b.EVENT_COMMITS}, main AS (
  SELECT {head}, count(*) AS commits,
         {share("count(*) FILTER (hour >= 22 OR hour < 6)", "count(*)")} AS night_ratio,
         {share("count(*) FILTER (hour >= 5 AND hour < 9)", "count(*)")} AS early_ratio,
         {share("count(*) FILTER (weekday >= 5)", "count(*)")} AS weekend_ratio,
         {share("count(*) FILTER (weekday < 5 AND hour >= 9 AND hour < 18)", "count(*)")} AS office_hours_ratio,
         count(*) FILTER (weekday = 4 AND hour >= 17) AS friday_evening_count, count(DISTINCT day) AS active_days,
         arg_min(day, at_s) AS first_commit_date, arg_max(day, at_s) AS last_commit_date
  FROM {source} {by}
), hours AS (
  SELECT {g}hour, count(*) AS n, row_number() OVER ({part}ORDER BY count(*) DESC, hour) AS place FROM {source} GROUP BY {g}hour
), reg AS (
  SELECT {head}, {share("sum(n) FILTER (place <= 6)", "sum(n)")} AS regularity FROM hours {by}
), days AS (
  SELECT {g}day, count(*) AS n, row_number() OVER ({part}ORDER BY count(*) DESC, day) AS place,
         datediff('day', lag(day) OVER ({part}ORDER BY day), day) AS gap,
         day - CAST(row_number() OVER ({part}ORDER BY day) AS INTEGER) AS island
  FROM {source} GROUP BY {g}day
), busy AS (SELECT {head}, day AS busiest_day, n AS busiest_day_commits FROM days WHERE place = 1
), runs AS (SELECT {g}island, count(*) AS length FROM days GROUP BY {g}island
), streak AS (SELECT {head}, max(length) AS longest_streak_days FROM runs {by}
), silent AS (SELECT {head}, greatest(coalesce(max(gap), 1) - 1, 0) AS longest_silence_days FROM days {by}
), stepped AS (SELECT {g}at_s - lag(at_s) OVER ({part}ORDER BY at_s) AS step FROM {source}
), elapsed AS (SELECT {head}, coalesce(max(step) // 86400, 0) AS elapsed_silence_days FROM stepped {by}
)
SELECT {extra}commits, night_ratio, early_ratio, weekend_ratio, office_hours_ratio, CAST(friday_evening_count AS BIGINT) AS friday_evening_count, active_days,
       first_commit_date, last_commit_date, regularity, busiest_day, busiest_day_commits, longest_streak_days, CAST(longest_silence_days AS BIGINT) AS longest_silence_days,
       CAST(elapsed_silence_days AS BIGINT) AS elapsed_silence_days, {share("commits", "active_days")} AS commits_per_active_day,
       CAST(datediff('day', first_commit_date, last_commit_date) AS BIGINT) AS repository_age_days,
       {share("active_days", "(datediff('day', first_commit_date, last_commit_date) + 1)")} AS span_ratio
FROM main JOIN reg USING ({on}) JOIN busy USING ({on}) JOIN streak USING ({on}) JOIN silent USING ({on}) JOIN elapsed USING ({on})"""


@query("temporal_profile", "WITH " + profile_sql(False))
def _(spark, sf_dir):
    return temporal.profile(_moments(spark, sf_dir))


@query("temporal_people", "WITH " + profile_sql(True))
def _(spark, sf_dir):
    return temporal.profile(_moments(spark, sf_dir), ["id"])


#: A scope of figures: some contributors as one person, in one year.
SCOPE = Scope(frozenset(range(1, 40, 2)), 2024)


@query("temporal_scope", "WITH " + profile_sql(False, "picked").replace("), main AS (", f"), picked AS (SELECT * FROM m WHERE id IN ({', '.join(map(str, sorted(SCOPE.ids)))}) AND year = {SCOPE.year}), main AS ("))
def _(spark, sf_dir):
    m = _moments(spark, sf_dir)
    return temporal.profile(m.filter(SCOPE.includes(F.col("id"), F.col("year"))))


for _name, _column, _values in (("hours", "hour", range(24)), ("weekdays", "weekday", range(7)), ("months", "month", range(1, 13))):

    @query(
        f"temporal_{_name}",
        f"WITH {b.EVENT_COMMITS} SELECT r.i AS bucket, count(m.hash) AS commits FROM (SELECT unnest(range({_values.start}, {_values.stop})) AS i) r LEFT JOIN m ON m.{_column} = r.i GROUP BY r.i",
    )
    def _(spark, sf_dir, column=_column, values=_values):
        return temporal.histogram(_moments(spark, sf_dir), column, values)


@query("temporal_years", f"WITH {b.EVENT_COMMITS} SELECT r.y AS year, count(m.hash) AS commits FROM (SELECT unnest(range((SELECT min(year) FROM m), (SELECT max(year) FROM m) + 1)) AS y) r LEFT JOIN m ON m.year = r.y GROUP BY r.y")
def _(spark, sf_dir):
    return temporal.year_histogram(_moments(spark, sf_dir))


@query("temporal_grid", f"WITH {b.EVENT_COMMITS} SELECT r.i // 24 AS weekday, r.i % 24 AS hour, count(m.hash) AS commits FROM (SELECT unnest(range(168)) AS i) r LEFT JOIN m ON m.weekday = r.i // 24 AND m.hour = r.i % 24 GROUP BY r.i")
def _(spark, sf_dir):
    return temporal.day_grid(_moments(spark, sf_dir))


@query("temporal_cells", f"WITH {b.EVENT_COMMITS} SELECT id, CAST(year AS INTEGER) AS year, day, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, count(*) AS commits, min(at_s) AS first_at, max(at_s) AS last_at FROM m GROUP BY ALL")
def _(spark, sf_dir):
    return temporal.cells(_moments(spark, sf_dir))


@query(
    "scope_cube",
    f"WITH {b.EVENT_COMMITS} SELECT id, year, count(*) AS commits, count(DISTINCT day) AS active_days, {share('count(*) FILTER (hour >= 22 OR hour < 6)', 'count(*)')} AS night_ratio FROM m GROUP BY CUBE (id, year)",
)
def _(spark, sf_dir):
    c = temporal.cells(_moments(spark, sf_dir)).withColumn("year", F.col("year").cast("long"))
    night = F.sum(F.when((F.col("hour") >= 22) | (F.col("hour") < 6), F.col("commits")).otherwise(0))
    return c.cube("id", "year").agg(F.sum("commits").alias("commits"), F.count_distinct("day").alias("active_days"), ratio(night, F.sum("commits")).alias("night_ratio"))


# --- commit size -----------------------------------------------------------------------------------------------

#: The outlier bound for the analog, whose commits have some hundred lines.
BULK = 300


def _sized(spark, sf_dir):
    c = b.change_keys(spark, sf_dir)
    return commit_size.sizes(c, "commit", "key", F.col("added"), F.col("deleted"), F.col("counted"), ("id", "date"))


SIZED = b.FILES + """, sized AS (
  SELECT commit, date, CAST(coalesce(sum(added) FILTER (ok), 0) AS BIGINT) AS added, CAST(coalesce(sum(deleted) FILTER (ok), 0) AS BIGINT) AS deleted,
         CAST(coalesce(sum(added + deleted) FILTER (ok), 0) AS BIGINT) AS lines, count(DISTINCT path) FILTER (ok) AS files
  FROM (SELECT *, NOT is_binary AND path NOT LIKE '%.min.js' AS ok FROM changes) GROUP BY commit, date
)"""


@query(
    "size_profile",
    f"""WITH {SIZED}, s AS (
  SELECT *, cume_dist() OVER (ORDER BY lines) AS cl, cume_dist() OVER (ORDER BY files) AS cf FROM sized WHERE lines <= {BULK}
)
SELECT count(*) AS commits, {one_place("avg(lines)")} AS mean_lines, {one_place("median(lines)")} AS median_lines, min(lines) FILTER (cl >= 0.9) AS p90_lines,
       {one_place("avg(files)")} AS mean_files, {one_place("median(files)")} AS median_files, min(files) FILTER (cf >= 0.9) AS p90_files,
       {share("count(*) FILTER (lines <= 20)", "count(*)")} AS small_commit_ratio, {share("count(*) FILTER (files = 1)", "count(*)")} AS single_file_ratio,
       {share("sum(added)", "sum(lines)")} AS addition_ratio, (SELECT count(*) FROM sized WHERE lines > {BULK}) AS bulk_commit_count
FROM s""",
)
def _(spark, sf_dir):
    return commit_size.profile(_sized(spark, sf_dir), BULK)


@query(
    "size_buckets",
    f"""WITH {SIZED} SELECT bucket, count(lines) AS commits FROM (VALUES ('0-9', 0, 9), ('10-49', 10, 49), ('50-199', 50, 199), ('200-999', 200, 999), ('1000+', 1000, 999999999)) v(bucket, a, z)
LEFT JOIN (SELECT * FROM sized WHERE lines <= {BULK}) s ON s.lines BETWEEN a AND z GROUP BY bucket""",
)
def _(spark, sf_dir):
    return commit_size.buckets(_sized(spark, sf_dir), BULK)


@query("size_largest", f"WITH {SIZED} SELECT commit, date, lines, files FROM sized WHERE lines <= {BULK} ORDER BY lines DESC, date, commit LIMIT 1")
def _(spark, sf_dir):
    return commit_size.largest(_sized(spark, sf_dir), BULK, "date")


@query("size_bulk", f"WITH {SIZED} SELECT commit, date, lines, files FROM sized WHERE lines > {BULK} ORDER BY lines DESC, date, commit LIMIT 10")
def _(spark, sf_dir):
    return commit_size.bulk(_sized(spark, sf_dir), BULK, "date")


@query(
    "size_people",
    f"""WITH {SIZED}, s AS (
  SELECT o_custkey AS id, s.*, cume_dist() OVER (PARTITION BY o_custkey ORDER BY lines > {BULK}, lines) * count(*) OVER (PARTITION BY o_custkey) AS kl,
         cume_dist() OVER (PARTITION BY o_custkey ORDER BY lines > {BULK}, files) * count(*) OVER (PARTITION BY o_custkey) AS kf,
         count(*) FILTER (lines <= {BULK}) OVER (PARTITION BY o_custkey) AS n
  FROM sized s JOIN orders ON commit = o_orderkey
)
SELECT id, count(*) FILTER (lines <= {BULK}) AS commits, {one_place(f"avg(lines) FILTER (lines <= {BULK})")} AS mean_lines, {one_place(f"median(lines) FILTER (lines <= {BULK})")} AS median_lines,
       min(lines) FILTER (lines <= {BULK} AND round(kl) >= ceil(round(0.9 * n, 6))) AS p90_lines, {one_place(f"avg(files) FILTER (lines <= {BULK})")} AS mean_files,
       {one_place(f"median(files) FILTER (lines <= {BULK})")} AS median_files, min(files) FILTER (lines <= {BULK} AND round(kf) >= ceil(round(0.9 * n, 6))) AS p90_files,
       {share(f"count(*) FILTER (lines <= 20 AND lines <= {BULK})", f"count(*) FILTER (lines <= {BULK})")} AS small_commit_ratio,
       {share(f"count(*) FILTER (files = 1 AND lines <= {BULK})", f"count(*) FILTER (lines <= {BULK})")} AS single_file_ratio,
       {share(f"sum(added) FILTER (lines <= {BULK})", f"sum(lines) FILTER (lines <= {BULK})")} AS addition_ratio, count(*) FILTER (lines > {BULK}) AS bulk_commit_count
FROM s GROUP BY id""",
)
def _(spark, sf_dir):
    return commit_size.profile(_sized(spark, sf_dir), BULK, ["id"])


# --- messages -----------------------------------------------------------------------------------------------


def _word(column: str, words: str) -> str:
    return f"regexp_matches({column}, '{text.word_pattern(words)}')"


CONVENTIONAL = f"regexp_matches(subject, '{text.CONVENTIONAL}')"
PREFIX = f"regexp_extract(subject, '{text.CONVENTIONAL}', 1)"
KEYWORD = "CASE " + " ".join("WHEN " + ("regexp_matches(subject, '(?i)^revert([^A-Za-z0-9_]|$)')" if n == "revert" else _word("subject", w)) + f" THEN '{n}'" for n, w in text.KEYWORDS) + " ELSE 'other' END"
TRIMMED = "regexp_replace(subject, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
REVERT = f"({TRIMMED} LIKE 'Revert \"%' OR CASE WHEN {CONVENTIONAL} THEN {PREFIX} ELSE {KEYWORD} END = 'revert')"
ISSUE = f"(regexp_matches(subject, '{text.ISSUE}') OR regexp_matches(body, '{text.ISSUE}'))"


def _message_sql(by: str = "") -> str:
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    ok = "NOT merge"
    return f"""WITH {b.MESSAGES}
SELECT {head}count(*) FILTER ({ok}) AS commits, {share(f"count(*) FILTER ({ok} AND {CONVENTIONAL})", f"count(*) FILTER ({ok})")} AS conventional_ratio,
       {one_place(f"avg(length(subject)) FILTER ({ok})")} AS mean_subject_length, median(length(subject)) FILTER ({ok}) AS median_subject_length,
       {share(f"count(*) FILTER ({ok} AND regexp_matches(body, '[^\\s\\p{{Z}}]'))", f"count(*) FILTER ({ok})")} AS body_ratio,
       count(*) FILTER ({ok} AND length(subject) <= 10) AS very_short_count,
       {share(f"count(*) FILTER ({ok} AND regexp_matches(subject, '{text.EMOJI}'))", f"count(*) FILTER ({ok})")} AS emoji_ratio,
       count(*) FILTER ({ok} AND {REVERT}) AS revert_count, count(*) FILTER ({ok} AND {_word(TRIMMED, text.TYPO)}) AS fix_typo_count,
       {share(f"count(*) FILTER ({ok} AND {_word('subject', text.WIP)})", f"count(*) FILTER ({ok})")} AS wip_ratio,
       {share(f"count(*) FILTER ({ok} AND {ISSUE})", f"count(*) FILTER ({ok})")} AS issue_reference_ratio,
       {share("count(*) FILTER (subject LIKE 'Merge %')", "count(*)")} AS merge_subject_ratio
FROM msg {group}"""


@query("message_profile", _message_sql())
def _(spark, sf_dir):
    return messages.profile(b.messages(spark, sf_dir), merges="merge")


@query("message_roles", _message_sql("role"))
def _(spark, sf_dir):
    return messages.profile(b.messages(spark, sf_dir), merges="merge", by=["role"])


@query("message_prefixes", f"WITH {b.MESSAGES} SELECT {PREFIX} AS prefix, count(*) AS commits FROM msg WHERE NOT merge AND {CONVENTIONAL} GROUP BY 1")
def _(spark, sf_dir):
    return messages.prefixes(b.messages(spark, sf_dir).filter("not merge"))


@query("message_keywords", f"WITH {b.MESSAGES} SELECT {KEYWORD} AS keyword, count(*) AS commits FROM msg WHERE NOT merge AND NOT {CONVENTIONAL} GROUP BY 1")
def _(spark, sf_dir):
    return messages.keywords(b.messages(spark, sf_dir).filter("not merge"))


@query("message_longest", f"WITH {b.MESSAGES} SELECT hash AS commit, date, length(message) AS chars FROM msg ORDER BY 3 DESC, 2, 1 LIMIT 1")
def _(spark, sf_dir):
    return messages.longest(b.messages(spark, sf_dir), "hash", "date", "message")


# --- files -----------------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    return b.file_changes(spark, sf_dir), b.head_files(spark, sf_dir)


TOUCHED = b.FILES + ", touched AS (SELECT path, count(*) AS commits, max(date) AS last_modified FROM changes GROUP BY path)"
EXTENSION = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"
DIRECTORIES = """spread AS (
  SELECT *, 1::BIGINT AS depth, string_split(path, '/')[1] AS directory FROM {0} WHERE len(string_split(path, '/')) > 1
  UNION ALL SELECT *, 2::BIGINT, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM {0} WHERE len(string_split(path, '/')) > 2
)"""


@query("files_most_modified", f"WITH {TOUCHED} SELECT path, commits, path NOT IN (SELECT path FROM head) AS removed FROM touched ORDER BY commits DESC, path LIMIT 25")
def _(spark, sf_dir):
    return files.most_modified(*_files(spark, sf_dir))


@query("files_oldest_untouched", f"WITH {TOUCHED} SELECT path, last_modified FROM touched WHERE path IN (SELECT path FROM head) ORDER BY last_modified, path LIMIT 1")
def _(spark, sf_dir):
    return files.oldest_untouched(*_files(spark, sf_dir))


@query(
    "files_extensions",
    f"""WITH {b.FILES}, c AS (SELECT {EXTENSION} AS extension, count(DISTINCT commit) AS n FROM changes GROUP BY 1), f AS (SELECT {EXTENSION} AS extension, count(DISTINCT path) AS n FROM head GROUP BY 1)
SELECT * FROM (SELECT 'commits' AS measure, * FROM c WHERE extension <> '' ORDER BY n DESC, extension LIMIT 20) UNION ALL SELECT * FROM (SELECT 'files', * FROM f WHERE extension <> '' ORDER BY n DESC, extension LIMIT 20)""",
)
def _(spark, sf_dir):
    return files.extensions(*_files(spark, sf_dir))


@query("files_directories", f"WITH {b.FILES}, {DIRECTORIES.format('changes')} SELECT depth, directory, count(DISTINCT commit) AS commits FROM spread GROUP BY 1, 2 HAVING count(DISTINCT commit) >= 10 ORDER BY 3 DESC, 2 LIMIT 50")
def _(spark, sf_dir):
    return files.directory_activity(b.file_changes(spark, sf_dir))


@query(
    "files_counts",
    f"""WITH {b.FILES} SELECT (SELECT count(DISTINCT path) FROM head) AS head_file_count, (SELECT count(DISTINCT path) FROM head WHERE text) AS tracked_text_file_count,
       (SELECT count(DISTINCT path) FROM changes WHERE path NOT IN (SELECT path FROM head)) AS deleted_file_count, count(previous_path) AS rename_count,
       count(DISTINCT commit) FILTER (is_new) AS new_file_commits, count(DISTINCT path) FILTER (is_new) AS new_file_count, count(DISTINCT string_split(path, '/')[1]) AS directories_touched,
       (SELECT count(DISTINCT string_split(path, '/')[1]) FROM head) AS directory_count FROM changes""",
)
def _(spark, sf_dir):
    return files.counts(*_files(spark, sf_dir))


@query("path_exclusion", f"WITH {b.FILES} SELECT path, path LIKE '%.min.js' AS excluded, count(*) AS n FROM changes GROUP BY 1")
def _(spark, sf_dir):
    return paths.with_exclusion(b.file_changes(spark, sf_dir).select("path")).groupBy("path", "excluded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_paths",
    """SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^(.[^.]*)', 1)) AS stem, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS extension,
       CASE WHEN len(string_split(url, '/')) > 3 THEN array_to_string(string_split(url, '/')[1:3], '/') END AS site FROM pages""",
)
def _(spark, sf_dir):
    url = F.col("url")
    return b.read(spark, sf_dir, "pages").select("page_id", paths.stem(url).alias("stem"), paths.extension(url).alias("extension"), paths.directory(url, 3).alias("site"))


# --- coupling -----------------------------------------------------------------------------------------------

#: The analog's suppliers are dealt evenly, so that confidences are low.
CONFIDENCE = 0.03


def _pairs_sql(source: str, commit: str, path: str, confidence: float) -> str:
    return f"""each_ AS (SELECT DISTINCT {commit} AS commit, {path} AS path FROM {source}
), totals AS (SELECT path, count(*) AS changes FROM each_ GROUP BY 1
), small AS (SELECT commit FROM each_ GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50
), found AS (
  SELECT a.path AS a, b.path AS b, count(*) AS support, count(*) / least(any_value(ta.changes), any_value(tb.changes)) AS confidence
  FROM each_ a JOIN each_ b ON a.commit = b.commit AND a.path < b.path JOIN small s ON s.commit = a.commit JOIN totals ta ON ta.path = a.path JOIN totals tb ON tb.path = b.path
  GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) / least(any_value(ta.changes), any_value(tb.changes)) >= {confidence}
)"""


SUPPLIED = _pairs_sql("lineitem", "l_orderkey", "l_suppkey", CONFIDENCE)


def _supplied(spark, sf_dir):
    return coupling.qualifying(b.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", confidence=CONFIDENCE)


@query("coupling_pairs", f"WITH {SUPPLIED} SELECT a, b, support, {sig('confidence')} AS confidence, a = b AS expected FROM found ORDER BY support DESC, {sig('confidence')} DESC, a, b LIMIT 200")
def _(spark, sf_dir):
    return coupling.pairs(_supplied(spark, sf_dir))


@query("coupling_ratio", f"WITH {SUPPLIED}, c AS (SELECT a AS path FROM found UNION SELECT b FROM found) SELECT count(*) AS coupled_files, {share('count(*)', '(SELECT count(DISTINCT l_suppkey) FROM lineitem)')} AS coupled_file_ratio FROM c")
def _(spark, sf_dir):
    return coupling.coupled_ratio(_supplied(spark, sf_dir), b.read(spark, sf_dir, "lineitem"), "l_suppkey")


MODULES = b.FILES + ", modules AS (SELECT commit, regexp_extract(path, '^(.*)/', 1) || '.go' AS path FROM changes), " + _pairs_sql("modules", "commit", "path", 0.02)


def _modules(spark, sf_dir):
    return coupling.qualifying(b.file_changes(spark, sf_dir).select("commit", F.concat(paths.directory(F.col("path"), 2), F.lit(".go")).alias("path")), confidence=0.02)


@query(
    "coupling_modules",
    f"""WITH {MODULES} SELECT a, b, support, {sig('confidence')} AS confidence, lower(regexp_extract(a, '/([^/.]*)', 1)) = lower(regexp_extract(b, '/([^/.]*)', 1)) AS expected
FROM found ORDER BY support DESC, {sig('confidence')} DESC, a, b LIMIT 200""",
)
def _(spark, sf_dir):
    return coupling.pairs(_modules(spark, sf_dir))


GRAPH = f"""WITH RECURSIVE {MODULES}, listed AS (
  SELECT *, row_number() OVER (ORDER BY support DESC, {sig('confidence')} DESC, a, b) AS place FROM (SELECT a, b, support, {sig('confidence')} AS confidence FROM found ORDER BY support DESC, confidence DESC, a, b LIMIT {LIMITS["coupling_pairs"]})
), nodes AS (SELECT l.place, (SELECT count(DISTINCT n) FROM (SELECT unnest([x.a, x.b]) AS n FROM listed x WHERE x.place <= l.place)) AS n FROM listed l)
SELECT a, b, support, confidence FROM listed WHERE place <= {LIMITS["coupling_graph_edges"]} AND place < coalesce((SELECT min(place) FROM nodes WHERE n > {LIMITS["coupling_graph_nodes"]}), 1000000)"""


@query("coupling_graph", GRAPH.replace("WITH RECURSIVE", "WITH"))
def _(spark, sf_dir):
    return coupling.graph(coupling.pairs(_modules(spark, sf_dir)))


# --- hotspot -----------------------------------------------------------------------------------------------


@query(
    "churn_files",
    """WITH t AS (SELECT l_partkey AS path, CAST(epoch(l_shipdate) AS BIGINT) AS at_s FROM lineitem
), w AS (SELECT path, count(*) OVER (PARTITION BY path ORDER BY at_s RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY path) AS total FROM t)
SELECT path, max(n) AS window_commits, max(total) AS total_commits FROM w GROUP BY path HAVING max(n) >= 5 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100""",
)
def _(spark, sf_dir):
    from lorelog.functions.times import epoch_seconds

    lines = b.read(spark, sf_dir, "lineitem").select("l_partkey", epoch_seconds(F.col("l_shipdate")).alias("at"))
    return hotspot.churn(lines, "l_partkey", "at")


@query("change_frequency", f"WITH {b.FILES} SELECT path, count(DISTINCT commit) AS change_frequency FROM changes GROUP BY 1")
def _(spark, sf_dir):
    return hotspot.frequency(b.file_changes(spark, sf_dir))


#: Text lines play the files' lines; every second line is indented by its number, as the table's texts aren't.
LINES = """lines_ AS (
  SELECT doc_id AS path, pos AS line_no, repeat(' ', CAST((pos % 4) * 2 AS BIGINT)) || line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), full_ AS (SELECT path, line_no, length(regexp_extract(text, '^( *)', 1)) AS spaces FROM lines_ WHERE NOT regexp_matches(text, '^\\s*$')
), steps AS (SELECT path, spaces - lag(spaces) OVER (PARTITION BY path ORDER BY line_no) AS step FROM full_
), counted AS (SELECT path, step, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, step) AS place FROM steps WHERE step > 0 GROUP BY path, step
), depth AS (SELECT f.path, least(spaces / coalesce(step, 1), 20.0) AS depth FROM full_ f LEFT JOIN counted c ON c.path = f.path AND place = 1
), complex_ AS (SELECT path, sum(depth) / count(*) * log2(count(*)) AS c, count(*) AS lines FROM depth GROUP BY path)"""


def _complexity(spark, sf_dir):
    split = F.posexplode(F.split("text", "\n"))
    lines = b.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), split.alias("at", "line"))
    indented = F.concat(F.repeat(F.lit(" "), ((F.col("at") + 1) % 4 * 2).cast("int")), F.col("line"))
    return hotspot.complexity(lines.select("path", (F.col("at") + 1).alias("line_no"), indented.alias("text")))


@query("complexity_proxy", f"WITH {LINES} SELECT path, {sig('c')} AS complexity_proxy, lines FROM complex_")
def _(spark, sf_dir):
    c = _complexity(spark, sf_dir)
    return c.select("path", significant(F.col("complexity_proxy")).alias("complexity_proxy"), "lines")


@query(
    "hotspots",
    f"""WITH {LINES}, both_ AS (SELECT path, c, coalesce(f, 0.0) AS f FROM complex_ LEFT JOIN (SELECT l_partkey AS path, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS f FROM lineitem GROUP BY 1) USING (path)
), scored AS (SELECT path, CAST(f AS BIGINT) AS change_frequency, {sig('c')} AS complexity_proxy,
  CASE WHEN max(f) OVER () > min(f) OVER () THEN (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) ELSE 0.0 END * CASE WHEN max(c) OVER () > min(c) OVER () THEN (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) ELSE 0.0 END AS s FROM both_)
SELECT path, change_frequency, complexity_proxy, {sig('s')} AS hotspot_score FROM scored ORDER BY 4 DESC, 1 LIMIT 100""",
)
def _(spark, sf_dir):
    return hotspot.hotspots(hotspot.frequency(b.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), _complexity(spark, sf_dir))


# --- ownership -----------------------------------------------------------------------------------------------


@query("ownership_lines", f"WITH {b.OWNED} SELECT owner_id, count(*) AS lines FROM lines GROUP BY 1")
def _(spark, sf_dir):
    return ownership.by_owner(b.owned_lines(spark, sf_dir))


def _bus_sql(keys: str) -> str:
    part, head = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""owned AS (SELECT {head}owner_id, count(*) AS lines FROM source_ GROUP BY {head}owner_id
), marked AS (SELECT *, coalesce(sum(lines) OVER ({part}ORDER BY lines DESC, owner_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(lines) OVER ({part}) AS total FROM owned)
SELECT {head}count(*) FILTER (before * 2 < total) AS bus_factor, {share("max(lines)", "max(total)")} AS largest_share, CAST(max(total) AS BIGINT) AS line_count FROM marked {group}"""


@query("ownership_bus_factor", f"WITH {b.OWNED}, source_ AS (SELECT * FROM lines), {_bus_sql('')}")
def _(spark, sf_dir):
    return ownership.bus_factor(ownership.by_owner(b.owned_lines(spark, sf_dir)))


@query("ownership_directories", f"WITH {b.OWNED}, {DIRECTORIES.format('lines')}, source_ AS (SELECT * FROM spread), {_bus_sql('depth, directory')}")
def _(spark, sf_dir):
    spread = files.with_directories(b.owned_lines(spark, sf_dir))
    return ownership.bus_factor(ownership.by_owner(spread, ["depth", "directory"]), ["depth", "directory"])


@query(
    "ownership_top_owners",
    f"""WITH {b.OWNED}, {DIRECTORIES.format('lines')}, o AS (SELECT depth, directory, owner_id, count(*) AS lines FROM spread GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY depth, directory ORDER BY lines DESC, owner_id) AS place FROM o) SELECT * FROM r WHERE place <= 10""",
)
def _(spark, sf_dir):
    spread = files.with_directories(b.owned_lines(spark, sf_dir))
    return ownership.top_owners(ownership.by_owner(spread, ["depth", "directory"]), ["depth", "directory"])


@query("ownership_ages", f"WITH {b.OWNED} SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS lines FROM lines GROUP BY 1")
def _(spark, sf_dir):
    return ownership.age_distribution(b.owned_lines(spark, sf_dir))


@query(
    "ownership_summary",
    f"""WITH {b.OWNED}, seen AS (SELECT l_suppkey AS owner_id, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1
), a AS (SELECT datediff('day', day, (SELECT max(day) FROM lines)) AS age, year(day) AS year, last_day IS NULL OR datediff('day', last_day, (SELECT max(day) FROM lines)) > 365 AS orphan FROM lines LEFT JOIN seen USING (owner_id))
SELECT count(*) AS line_count, median(age) AS median_line_age_days, {share("count(*) FILTER (year = (SELECT min(year) FROM a))", "count(*)")} AS first_year_survival_ratio, {share("count(*) FILTER (orphan)", "count(*)")} AS orphaned_line_ratio FROM a""",
)
def _(spark, sf_dir):
    lines = b.owned_lines(spark, sf_dir)
    seen = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("owner_id")).agg(F.max(F.to_date("l_shipdate")).alias("last_day"))
    head = lines.agg(F.max("day")).first()[0]
    return ownership.summary(lines, F.lit(head), seen)


# --- worktype -----------------------------------------------------------------------------------------------

WINDOW = 30
WORK_CLASS = f"CASE WHEN kind = 'addition' THEN 'new_work' WHEN age_days >= {WINDOW} THEN 'legacy_refactor' WHEN editor = owner THEN 'rework' ELSE 'help_others' END"


def _edits(spark, sf_dir):
    return worktype.consecutive_events(b.edits(spark, sf_dir), "l_partkey", "l_suppkey", "day", ["day", "l_orderkey", "l_linenumber"])


@query("worktype_breakdown", f"WITH {b.EDITS} SELECT editor, CASE WHEN kind <> 'addition' THEN owner END AS owner, {WORK_CLASS} AS work_class, count(*) AS lines FROM edits GROUP BY ALL")
def _(spark, sf_dir):
    return worktype.breakdown(_edits(spark, sf_dir), WINDOW)


SHARES = ", ".join(f"{share(f'''count(*) FILTER (c = '{c}')''', 'count(*)')} AS {c}" for c in worktype.CLASSES)


@query("worktype_shares", f"WITH {b.EDITS}, k AS (SELECT {WORK_CLASS} AS c FROM edits) SELECT {SHARES}, count(*) AS classified_line_count, {WINDOW}::BIGINT AS recency_window_days FROM k")
def _(spark, sf_dir):
    return worktype.shares(worktype.breakdown(_edits(spark, sf_dir), WINDOW), WINDOW)


PICKED = list(range(1, 60, 3))


@query(
    "worktype_selection",
    f"""WITH {b.EDITS}, k AS (SELECT CASE WHEN {WORK_CLASS} = 'help_others' AND owner IN ({', '.join(map(str, PICKED))}) THEN 'rework' ELSE {WORK_CLASS} END AS c FROM edits WHERE editor IN ({', '.join(map(str, PICKED))}))
SELECT {SHARES}, count(*) AS classified_line_count, {WINDOW}::BIGINT AS recency_window_days FROM k""",
)
def _(spark, sf_dir):
    return worktype.selected_shares(worktype.breakdown(_edits(spark, sf_dir), WINDOW), PICKED, WINDOW)


# --- assisted -----------------------------------------------------------------------------------------------

TRAILERS = {0: "x\n\nCo-authored-by: assistant <a@b>", 1: "x\n\nbody\n\nCo-authored-by: Some Agent <c@d>", 2: "x\n\nCo-authored-by: Ada <ada@x>\n", 3: "Generated with: tool\n\nx", 4: "Co-authored-by: assistant <a@b>\n\nx"}


def _assisted(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders")
    message = F.lit("plain")
    for k, m in TRAILERS.items():
        message = F.when(F.col("o_orderkey") % 11 == k, m).otherwise(message)
    size = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("effective"))
    tool = assisted.tool_of(message)
    c = o.withColumn("tool", tool).join(size, "o_orderkey", "left")
    return c.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.coalesce("effective", F.lit(0)).alias("effective"), (F.coalesce("effective", F.lit(0)) > BULK).alias("bulk"), F.col("tool").isNotNull().alias("assisted"), "tool")


ASSISTED = f"""c AS (SELECT o_orderkey AS commit, o_custkey AS id, CAST(o_orderdate AS DATE) AS day, coalesce(e, 0) AS effective, coalesce(e, 0) > {BULK} AS bulk,
  CASE o_orderkey % 11 WHEN 0 THEN 'assistant' WHEN 1 THEN 'agent' WHEN 3 THEN 'generated' END AS tool, o_orderkey % 11 IN (0, 1, 3) AS assisted
  FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, sum(CAST(l_quantity AS BIGINT)) AS e FROM lineitem GROUP BY 1) USING (o_orderkey))"""


@query(
    "assisted_summary",
    f"""WITH {b.EDITS}, {ASSISTED}, alive AS (SELECT count(*) FILTER (assisted) AS a, count(*) FILTER (NOT assisted) AS u FROM lineitem JOIN c ON commit = l_orderkey
), wrote AS (SELECT count(*) FILTER (assisted) AS a, count(*) FILTER (NOT assisted) AS u FROM edits JOIN c USING (commit)
), again AS (SELECT count(*) FILTER (assisted) AS a, count(*) FILTER (NOT assisted) AS u FROM edits e JOIN c ON c.commit = e.writer WHERE age_days < {WINDOW}
), base AS (SELECT count(*) FILTER (assisted) AS assisted_commit_count, {share("count(*) FILTER (assisted)", "count(*)")} AS assisted_commit_ratio, min(day) FILTER (assisted) AS first_assisted_commit_date,
  {one_place("avg(effective) FILTER (assisted AND NOT bulk)")} AS assisted_mean_lines, {one_place("avg(effective) FILTER (NOT assisted AND NOT bulk)")} AS unassisted_mean_lines, {share("count(DISTINCT id) FILTER (assisted)", "count(DISTINCT id)")} AS assisted_identity_ratio FROM c)
SELECT base.*, {share("alive.a", "(alive.a + alive.u)")} AS assisted_line_share, {share("again.a", "wrote.a")} AS assisted_rework_ratio, {share("alive.a", "wrote.a")} AS assisted_survival_ratio,
  {share("again.u", "wrote.u")} AS unassisted_rework_ratio, {share("alive.u", "wrote.u")} AS unassisted_survival_ratio, '1' AS detection_rules_version FROM base, alive, wrote, again""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("day", "l_orderkey", "l_linenumber")
    e = b.edits(spark, sf_dir).select(
        F.when(F.lag("l_suppkey").over(w).isNull(), "addition").otherwise("replacement").alias("kind"), F.col("l_orderkey").alias("commit"), F.lag("l_orderkey").over(w).alias("writer"),
        F.datediff("day", F.lag("day").over(w)).alias("age_days"), F.lit(1).alias("n"),
    )
    lines = b.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit")).agg(F.count(F.lit(1)).alias("n"))
    return assisted.summary(_assisted(spark, sf_dir), lines, e, WINDOW)


@query("assisted_tools", f"WITH {ASSISTED} SELECT tool, count(*) AS commits FROM c WHERE assisted GROUP BY 1")
def _(spark, sf_dir):
    return assisted.tools(_assisted(spark, sf_dir))


# --- identities -----------------------------------------------------------------------------------------------


def _known(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"))
    return identities.table(o)


KNOWN = """known AS (SELECT o_custkey AS id, count(*) AS commit_count, min(CAST(o_orderdate AS DATE)) AS first_commit_date, max(CAST(o_orderdate AS DATE)) AS last_commit_date,
  row_number() OVER (ORDER BY count(*) DESC, min(CAST(o_orderdate AS DATE)), o_custkey) <= 200 AS individual FROM orders GROUP BY 1)"""


@query("identity_table", f"WITH {KNOWN} SELECT * FROM known")
def _(spark, sf_dir):
    return _known(spark, sf_dir)


@query(
    "identity_listing",
    f"""WITH {KNOWN} SELECT id, first_commit_date, last_commit_date, commit_count, 1::BIGINT AS identities, false AS aggregate FROM known WHERE individual
UNION ALL SELECT NULL, min(first_commit_date), max(last_commit_date), CAST(sum(commit_count) AS BIGINT), count(*), true FROM known WHERE NOT individual HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    return identities.listing(_known(spark, sf_dir))


@query(
    "identity_candidates",
    f"""WITH {KNOWN}, p AS (SELECT id, 'name ' || (id % 50) AS n, 'name' || (id % 50) AS compact, CASE WHEN id % 4 = 0 THEN 'user' || (id % 30) WHEN id % 4 > 1 THEN 'u' || id END AS loc, CASE WHEN id % 4 = 1 THEN 'user' || (id % 30) END AS acc FROM known WHERE individual
), s AS (SELECT a.id, b.id AS candidate, a.n = b.n AS s1, a.loc = b.loc AS s2, coalesce(a.acc IN (b.loc, b.acc, b.compact), false) OR coalesce(b.acc IN (a.loc, a.acc, a.compact), false) OR coalesce(a.acc = b.loc, false) OR coalesce(a.acc = b.acc, false) OR coalesce(b.acc = a.loc, false) AS s3 FROM p a JOIN p b ON a.id <> b.id)
SELECT id, candidate, 'display_name' AS signal FROM s WHERE s1 UNION ALL SELECT id, candidate, 'local_part' FROM s WHERE s2 UNION ALL SELECT id, candidate, 'noreply' FROM s WHERE s3""",
)
def _(spark, sf_dir):
    k = F.col("id")
    mail = F.when(k % 4 == 0, F.concat(F.lit("User"), k % 30, F.lit("@x.org"))).when(k % 4 == 1, F.concat(k, F.lit("+user"), k % 30, F.lit("@users.noreply.github.com"))).otherwise(F.concat(F.lit("u"), k, F.lit("@y.org")))
    rows = _known(spark, sf_dir).filter("individual").select("id", F.concat(F.lit(" Name  "), k % 50).alias("name"), mail.alias("email"))
    return identities.merge_candidates(identities.evidence(rows, "id", "name", ["email"]))


@query("identity_digest", "SELECT c_custkey, substr(sha256(lower(trim(c_name))), 1, 16) AS id FROM customer")
def _(spark, sf_dir):
    return b.read(spark, sf_dir, "customer").select("c_custkey", people.digest(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t"))).alias("id"))


# --- interpretation -----------------------------------------------------------------------------------------------

AXES_SQL = f"""{profile_sql(True).replace("FROM main JOIN", ", first_at, last_at FROM main JOIN").replace("arg_max(day, at_s) AS last_commit_date", "arg_max(day, at_s) AS last_commit_date, min(at_s) AS first_at, max(at_s) AS last_at")}"""


def _axes(spark, sf_dir):
    m = _moments(spark, sf_dir)
    return interpret.person_axes(temporal.profile(m, ["id"]), m)


AXES = f"""WITH prof AS (WITH {AXES_SQL}), whole AS (SELECT sum(commits) AS n, count(*) AS people, min(first_at) AS a, max(last_at) AS z, datediff('day', arg_min(first_commit_date, first_at), arg_max(last_commit_date, last_at)) AS age FROM prof
), axes AS (SELECT id, night_ratio AS nocturnality, early_ratio AS earliness, weekend_ratio AS weekend_presence, {share("friday_evening_count", "commits")} AS friday_evening_share, regularity,
  commits_per_active_day AS cadence, {share("active_days", "nullif(age, 0)")} AS endurance, repository_age_days AS personal_span_days, {share("commits", "n")} AS volume_share, first_at = a AS first_contributor, last_at = z AS most_recent_contributor,
  CAST(people AS BIGINT) AS identity_count, commits, active_days, longest_streak_days AS streak_days, elapsed_silence_days AS longest_personal_silence_days, friday_evening_count AS friday_evening_commits,
  rank() OVER (ORDER BY night_ratio DESC) AS rank_nocturnality, rank() OVER (ORDER BY early_ratio DESC) AS rank_earliness, rank() OVER (ORDER BY weekend_ratio DESC) AS rank_weekend, rank() OVER (ORDER BY longest_streak_days DESC) AS rank_streak, rank() OVER (ORDER BY {share("commits", "n")} DESC) AS rank_volume
  FROM prof, whole)"""


@query("person_axes", f"{AXES} SELECT * FROM axes")
def _(spark, sf_dir):
    return _axes(spark, sf_dir)


@query("person_archetypes", f"{AXES} SELECT id, {interpret.archetype_sql(interpret.PERSON, interpret.TIME_AXES)} AS archetype FROM axes")
def _(spark, sf_dir):
    axes = _axes(spark, sf_dir)
    return axes.select("id", interpret.archetype(axes, interpret.PERSON).alias("archetype"))


@query("person_badges", f"{AXES} " + " UNION ALL ".join(f"SELECT id, '{badge}' AS badge FROM axes WHERE {cond}" for badge, cond in interpret.badge_sql(interpret.TIME_AXES)))
def _(spark, sf_dir):
    return interpret.awarded(_axes(spark, sf_dir), "id")


SKIPS = [(name, ",".join(sorted(set(when) - interpret.TIME_AXES))) for name, when in interpret.BADGES if not set(when) <= interpret.TIME_AXES]


@query("badge_skips", "SELECT * FROM (VALUES " + ", ".join(f"('{badge}', '{missing}')" for badge, missing in SKIPS) + ") v(badge, missing)")
def _(spark, sf_dir):
    return interpret.skipped(_axes(spark, sf_dir))


@query("static_analysis", "SELECT 'static_analysis' AS family, 'skipped' AS status, 'not_implemented' AS reason")
def _(spark, sf_dir):
    return spark.createDataFrame([("static_analysis", "skipped", "not_implemented")], "family string, status string, reason string")


# --- history graph and replay ---------------------------------------------------------------------------------

#: Customers play commits: number k has the parents k / 2 and, where it differs, k / 3.
EDGES = "edges AS (SELECT DISTINCT c_custkey AS child, p AS parent FROM customer, (SELECT unnest([2, 3]) AS d), LATERAL (SELECT c_custkey // d AS p) WHERE c_custkey // d > 0)"


def _edges(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"))
    halves = F.array(F.floor(F.col("child") / 2), F.floor(F.col("child") / 3))
    return c.select("child", F.explode(F.array_distinct(halves)).alias("parent")).filter("parent > 0")


@query("dag_ancestors", f"WITH RECURSIVE {EDGES}, up(node) AS (SELECT max(c_custkey) FROM customer UNION SELECT parent FROM up JOIN edges ON child = node) SELECT node FROM up")
def _(spark, sf_dir):
    head = b.read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return dag.ancestors(_edges(spark, sf_dir), head)


#: Every parent here is smaller than its child, so the order by the smallest free node is that of the numbers.
@query(
    "dag_levels",
    f"""WITH RECURSIVE {EDGES}, roots AS (SELECT parent AS node FROM edges EXCEPT SELECT child FROM edges),
walk(node, level) AS (SELECT node, 0 FROM roots UNION SELECT child, level + 1 FROM walk JOIN edges ON parent = node),
deepest AS (SELECT node, max(level) AS level FROM walk GROUP BY node)
SELECT node, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS position FROM deepest""",
)
def _(spark, sf_dir):
    return dag.levels(_edges(spark, sf_dir))


@query("replay_alignment")
def _(spark, sf_dir):
    return replay.align_neighbours(b.read(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")


@query("catalogue_limits", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in LIMITS.items()) + ") v(name, value)")
def _(spark, sf_dir):
    return spark.createDataFrame(list(LIMITS.items()), "name string, value long")


# --- further projections -----------------------------------------------------------------------------------

EDITOR_AXES = f"""work AS (SELECT editor AS id, {WORK_CLASS} AS c FROM edits), axes AS (
  SELECT id, {share("count(*) FILTER (c = 'new_work')", "count(*)")} AS creation, {share("count(*) FILTER (c = 'legacy_refactor')", "count(*)")} AS restoration,
         {share("count(*) FILTER (c = 'rework')", "count(*)")} AS revision, {share("count(*) FILTER (c = 'help_others')", "count(*)")} AS collaboration FROM work GROUP BY 1)"""


@query("worktype_people", f"WITH {b.EDITS}, {EDITOR_AXES} SELECT *, {interpret.archetype_sql(interpret.PERSON, {'creation', 'restoration', 'revision', 'collaboration'})} AS archetype FROM axes")
def _(spark, sf_dir):
    cells = worktype.breakdown(_edits(spark, sf_dir), WINDOW)
    axes = worktype.person_shares(cells)
    return axes.select("*", interpret.archetype(axes, interpret.PERSON).alias("archetype"))


@query(
    "repository_archetype",
    f"""WITH prof AS (WITH {profile_sql(False)}), axes AS (SELECT night_ratio AS nocturnality, weekend_ratio AS weekend_presence, office_hours_ratio AS office_hours, regularity, span_ratio, longest_silence_days, repository_age_days FROM prof)
SELECT {interpret.archetype_sql(interpret.REPOSITORY, {"nocturnality", "weekend_presence", "office_hours", "regularity", "span_ratio", "longest_silence_days", "repository_age_days"})} AS archetype FROM axes""",
)
def _(spark, sf_dir):
    axes = interpret.repository_axes(temporal.profile(_moments(spark, sf_dir)))
    return axes.select(interpret.archetype(axes, interpret.REPOSITORY).alias("archetype"))


@query("temporal_month_delta", f"WITH {b.EVENT_COMMITS}, c AS (SELECT year, month, count(*) AS commits FROM m GROUP BY 1, 2) SELECT year, month, commits, commits - lag(commits) OVER (ORDER BY year, month) AS delta FROM c")
def _(spark, sf_dir):
    return temporal.month_delta(_moments(spark, sf_dir))


@query(
    "temporal_single_minute",
    f"WITH {b.EVENT_COMMITS}, c AS (SELECT id, at_s // 60 AS minute, count(*) AS n FROM m GROUP BY 1, 2) SELECT id, max(n) AS max_commits_in_one_minute, (SELECT count(*) FROM m x WHERE x.id = c.id AND x.hour = 0) AS commits_in_hour_0 FROM c GROUP BY id",
)
def _(spark, sf_dir):
    return temporal.instants(_moments(spark, sf_dir))


# --- cells: what a scope says is what its cells say ----------------------------------------------------------

#: Some contributors as one person, in one year of the orders.
CHANGE_SCOPE = Scope(frozenset(range(1, 200, 3)), 1995)
CHANGE_IDS = ", ".join(map(str, sorted(CHANGE_SCOPE.ids)))


def _in_scope(cells: DataFrame, who: str = "id") -> DataFrame:
    return cells.filter(CHANGE_SCOPE.includes(F.col(who), F.col("year")))


@query(
    "size_scope",
    f"""WITH {SIZED}, picked AS (SELECT s.* FROM sized s JOIN orders ON commit = o_orderkey WHERE o_custkey IN ({CHANGE_IDS}) AND year(date) = {CHANGE_SCOPE.year}
), s AS (SELECT *, cume_dist() OVER (ORDER BY lines) AS cl, cume_dist() OVER (ORDER BY files) AS cf FROM picked WHERE lines <= {BULK})
SELECT count(*) AS commits, {one_place("avg(lines)")} AS mean_lines, {one_place("median(lines)")} AS median_lines, min(lines) FILTER (cl >= 0.9) AS p90_lines,
       {one_place("avg(files)")} AS mean_files, {one_place("median(files)")} AS median_files, min(files) FILTER (cf >= 0.9) AS p90_files,
       {share("count(*) FILTER (lines <= 20)", "count(*)")} AS small_commit_ratio, {share("count(*) FILTER (files = 1)", "count(*)")} AS single_file_ratio,
       {share("sum(added)", "sum(lines)")} AS addition_ratio, (SELECT count(*) FROM picked WHERE lines > {BULK}) AS bulk_commit_count FROM s""",
)
def _(spark, sf_dir):
    cells = commit_size.cells(_sized(spark, sf_dir).withColumn("year", F.year("date")), BULK)
    return commit_size.profile_of_cells(_in_scope(cells))


@query("size_cells", f"WITH {SIZED} SELECT o_custkey AS id, CAST(year(date) AS INTEGER) AS year, lines, files, lines > {BULK} AS bulk, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added FROM sized JOIN orders ON commit = o_orderkey GROUP BY ALL")
def _(spark, sf_dir):
    return commit_size.cells(_sized(spark, sf_dir).withColumn("year", F.year("date")), BULK)


@query("message_scope", f"SELECT * EXCLUDE (merge_subject_ratio) FROM ({_message_sql('role')})")
def _(spark, sf_dir):
    told = b.messages(spark, sf_dir).filter("not merge").withColumn("year", F.col("date") % 10)  # conversations play years
    cells = messages.cells(told, "role")
    return messages.profile_of_cells(cells, ["id"]).withColumnRenamed("id", "role")


@query(
    "files_scope",
    f"""WITH {b.FILES}, picked AS (SELECT * FROM changes WHERE id IN ({CHANGE_IDS}) AND year(date) = {CHANGE_SCOPE.year}), {DIRECTORIES.format("picked")}
SELECT depth, directory, count(*) AS entries, count(DISTINCT path) AS paths FROM spread GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return files.directories_of_cells(_in_scope(files.cells(b.file_changes(spark, sf_dir))))


@query("ownership_cells", f"WITH {b.OWNED} SELECT owner_id, CAST(year(day) AS INTEGER) AS year, path, count(*) AS lines FROM lines GROUP BY ALL")
def _(spark, sf_dir):
    return ownership.cells(b.owned_lines(spark, sf_dir))


@query(
    "ownership_scope",
    f"WITH {b.OWNED}, source_ AS (SELECT * FROM lines WHERE owner_id IN ({CHANGE_IDS}) AND year(day) = {CHANGE_SCOPE.year}), {_bus_sql('')}",
)
def _(spark, sf_dir):
    cells = _in_scope(ownership.cells(b.owned_lines(spark, sf_dir)), "owner_id")
    return ownership.bus_factor(cells.groupBy("owner_id").agg(F.sum("lines").alias("lines")))


EDITS_BY_YEAR = b.EDITS.replace("datediff('day', old_day, day) AS age_days FROM ordered", "datediff('day', old_day, day) AS age_days, CAST(year(day) AS INTEGER) AS year FROM ordered")


@query("worktype_cells", f"WITH {EDITS_BY_YEAR} SELECT editor, year, CASE WHEN kind <> 'addition' THEN owner END AS owner, {WORK_CLASS} AS work_class, count(*) AS lines FROM edits GROUP BY ALL")
def _(spark, sf_dir):
    return worktype.cells(_edits(spark, sf_dir), WINDOW)


@query("worktype_scope", f"WITH {EDITS_BY_YEAR}, k AS (SELECT CASE WHEN {WORK_CLASS} = 'help_others' AND owner IN ({CHANGE_IDS}) THEN 'rework' ELSE {WORK_CLASS} END AS c FROM edits WHERE editor IN ({CHANGE_IDS}) AND year = {CHANGE_SCOPE.year}) SELECT {SHARES}, count(*) AS classified_line_count, {WINDOW}::BIGINT AS recency_window_days FROM k")
def _(spark, sf_dir):
    cells = worktype.cells(_edits(spark, sf_dir), WINDOW).filter(F.col("year") == CHANGE_SCOPE.year)
    return worktype.selected_shares(cells, sorted(CHANGE_SCOPE.ids), WINDOW)


#: At most so many identities stand alone; the others are one bucket (null).
FEW = 12


@query(
    "worktype_folded",
    f"""WITH {b.EDITS}, few AS (SELECT editor AS id FROM edits GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {FEW}), k AS (SELECT *, {WORK_CLASS} AS work_class FROM edits)
SELECT CASE WHEN editor IN (SELECT id FROM few) THEN editor END AS editor, CASE WHEN kind <> 'addition' AND owner IN (SELECT id FROM few) THEN owner END AS owner, work_class, count(*) AS lines FROM k GROUP BY ALL""",
)
def _(spark, sf_dir):
    events = _edits(spark, sf_dir)
    few = events.groupBy(F.col("editor").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(FEW)
    return worktype.breakdown(events, WINDOW, few)


@query("identity_resolver", f"WITH {b.EVENT_COMMITS} SELECT id, count(*) AS commits, 1::BIGINT AS addresses FROM m GROUP BY 1")
def _(spark, sf_dir):
    return identities.resolver_listing(b.event_commits(spark, sf_dir))


@query(
    "temporal_year_delta",
    f"""WITH {b.EVENT_COMMITS}, y AS (SELECT year, count(*) AS commits, count(DISTINCT day) AS active_days, count(DISTINCT id) AS people FROM m GROUP BY 1)
SELECT y.*, y.commits - p.commits AS commits_delta, y.active_days - p.active_days AS active_days_delta, y.people - p.people AS people_delta FROM y LEFT JOIN y p ON p.year = y.year - 1""",
)
def _(spark, sf_dir):
    return temporal.year_delta(_moments(spark, sf_dir))
