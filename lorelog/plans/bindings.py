"""The commit-log roles played by ordinary tables, in Spark and in SQL.

events: commits with a time of day; orders x lineitem x part: commits with files; lineitem: surviving lines and line
edits; conversations: messages; customer: contributors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.functions import paths, times

OFFSETS = (0, 180, -300)
SUBJECTS = ("fix: ", "feat(core)!: ", 'Revert "', "Merge branch ", "WIP ", "Update docs for #12 ", "fix typo in ", "add ABC-12 ", "✨ ", "", "docs: ", "bump dependency ")
NAMES = (".go", "_test.go", ".min.js", ".py", "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, id, local, size, kind): the offset goes by the author."""
    e = read(spark, sf_dir, "events")
    offset = F.element_at(F.array(*map(F.lit, OFFSETS)), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("hash"), F.col("user_id").alias("id"), times.local_time(F.col("ts"), offset).alias("local"), F.col("event_type").alias("kind"))


EVENT_COMMITS = """commits AS (
  SELECT event_id AS hash, user_id AS id, event_type AS kind,
         ts + (CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 180 ELSE -300 END) * INTERVAL 1 MINUTE AS local
  FROM events
), m AS (
  SELECT hash, id, CAST(floor(epoch(local)) AS BIGINT) AS at_s, CAST(local AS DATE) AS day, CAST(hour(local) AS BIGINT) AS hour,
         CAST(isodow(local) - 1 AS BIGINT) AS weekday, CAST(month(local) AS BIGINT) AS month, CAST(year(local) AS BIGINT) AS year
  FROM commits
)"""


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", "p_size", F.concat(F.lower("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/item"), F.col("p_partkey").cast("string"), name).alias("path"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, id, date, at, path, previous_path, is_new, added, deleted, is_binary)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part_paths(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("commit"),
        F.col("o_custkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        times.epoch_seconds(F.col("o_orderdate")).alias("at"),
        "path",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.concat(F.lit("old/"), F.col("path"))).alias("previous_path"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("is_new"),
        F.col("l_quantity").cast("long").alias("added"),
        F.col("l_linenumber").cast("long").alias("deleted"),
        (F.col("l_linenumber") == 7).alias("is_binary"),
    )


def change_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, id, date, key, counted, added, deleted): file changes by the number of the file.

    The rule of minified files is judged once a file, and no path is joined to a change.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    plain = part_paths(spark, sf_dir).select("p_partkey", (~paths.any_glob(F.col("path"), ["**/*.min.js"])).alias("plain"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(plain, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("id"), "date", F.col("l_partkey").alias("key"), (F.col("plain") & (F.col("l_linenumber") != 7)).alias("counted"),
        F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"),
    )


def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).filter("p_size <= 40").select("path", (F.col("p_size") <= 30).alias("text"))


FILES = """paths AS (
  SELECT p_partkey, p_size, lower(p_type) || '/' || p_brand || '/item' || p_partkey ||
         CASE p_partkey % 5 WHEN 0 THEN '.go' WHEN 1 THEN '_test.go' WHEN 2 THEN '.min.js' WHEN 3 THEN '.py' ELSE '' END AS path
  FROM part
), changes AS (
  SELECT l_orderkey AS commit, o_custkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(epoch(o_orderdate) AS BIGINT) AS at_s, path,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'old/' || path END AS previous_path,
         l_linestatus = 'F' AND l_linenumber = 1 AS is_new, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted,
         l_linenumber = 7 AS is_binary
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN paths ON l_partkey = p_partkey
), head AS (SELECT path, p_size <= 30 AS text FROM paths WHERE p_size <= 40)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, date, message, subject, body, merge): turns of conversations with a lead by their number."""
    c = read(spark, sf_dir, "conversations")
    lead = F.element_at(F.array(*map(F.lit, SUBJECTS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(SUBJECTS) + 1).cast("int"))
    message = F.concat(lead, F.coalesce("text", F.lit("")))
    from lorelog.functions import text

    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("hash"), F.col("conv_id").alias("date"), message.alias("message"), (F.col("conv_id") % 10 == 0).alias("merge"), "role").withColumns(
        {"subject": text.subject_of(F.col("message")), "body": text.body_of(F.col("message"))}
    )


MESSAGES = f"""raw AS (
  SELECT conv_id * 1000 + turn AS hash, conv_id AS date, role, conv_id % 10 = 0 AS merge,
         CASE (conv_id * 5 + turn) % {len(SUBJECTS)} {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUBJECTS))} END || coalesce(text, '') AS message
  FROM conversations
), msg AS (
  SELECT *, string_split(message, chr(10))[1] AS subject, regexp_extract(message, '(?s)\\n[ \\t\\r]*\\n(.*)$', 1) AS body FROM raw
)"""


def owned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, owner_id, day): a surviving line per row of lineitem."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey")
    named = part_paths(spark, sf_dir).select("p_partkey", "path")
    return lines.join(named, F.col("l_partkey") == F.col("p_partkey")).select("path", F.col("l_suppkey").alias("owner_id"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("commit"))


OWNED = FILES + """, lines AS (
  SELECT path, l_suppkey AS owner_id, CAST(l_shipdate AS DATE) AS day, l_orderkey AS commit FROM lineitem JOIN paths ON l_partkey = p_partkey
)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return lines.withColumn("day", F.to_date("l_shipdate"))


EDITS = """ordered AS (
  SELECT l_suppkey AS editor, lag(l_suppkey) OVER w AS owner, l_orderkey AS commit, lag(l_orderkey) OVER w AS writer,
         CAST(l_shipdate AS DATE) AS day, lag(CAST(l_shipdate AS DATE)) OVER w AS old_day
  FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber)
), edits AS (
  SELECT editor, owner, commit, writer, CASE WHEN owner IS NULL THEN 'addition' ELSE 'replacement' END AS kind,
         datediff('day', old_day, day) AS age_days FROM ordered
)"""
