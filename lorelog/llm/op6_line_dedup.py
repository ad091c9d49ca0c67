"""Line dedup over levelled sorted runs of line hashes.

The store is a list of runs: (hash, n_docs, holder), each a table bucketed and sorted by hash, all with the same number
of buckets.  Batches come in descending order of document id.  A new batch is dealt by hash once and merge-anti-joins
the runs, which are read where they lie, without an exchange or a sort: hashes that no run has are new, and the batch's
largest id is their holder; for hashes that a run has, the batch adds only its count.  When a level has ``FANOUT`` runs
they are merge-joined into one run of the next level.  After the last batch the runs hold, for every line, in how many
documents it occurs and which document is the largest.

Only hashes (16 bytes) and places go through the store.  The places of dropped lines meet their documents by id; a
document without such lines passes straight through, but for one in 16 that a bit array of the others' ids can't tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import BLANKS, array_bits, bit_pages, bucketed, drop_bucketed, drop_stored, join_by_class, lower_ascii, stored, unused, whole_text, with_bit

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Bits of the array of ids at most (32 MB); over a sixteenth as many changed documents, more of the others shuffle.
ID_BITS = 1 << 28
#: Ids below any real one, for rows without an id.
NO_ID = -(2**63)


def line_digest(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """MD5 of the key in digits (128 bits, so that equal digests mean equal keys at any size); null for short keys.

    The key is the line without blanks at both ends, A-Z lower-cased, which changes no length.  In ASCII that is lower().
    """
    trimmed = F.btrim(line, F.lit(BLANKS))
    key = F.when(F.octet_length(line) == F.char_length(line), F.lower(trimmed)).otherwise(lower_ascii(trimmed))
    return F.when(F.char_length(line) >= min_chars, F.when(F.char_length(trimmed) >= min_chars, F.md5(key)))


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made in here take the order of a bucket that is one file from the table."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled store.  Runs are tables in the shared folder, so a lost executor costs no more than the step at work."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _written(rows: DataFrame) -> DataFrame:
        with _sorted_buckets(rows.sparkSession):
            return bucketed(rows, "run", "hash", dealt=True)

    def anti_joined(self, batch: DataFrame) -> DataFrame:
        """One row per hash of the batch's (id, hash): n_docs, and holder where no run has the hash."""
        own = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("holder"))
        known = F.lit(False)
        for k, run in enumerate(self.runs()):
            # a run of a merged level has a holder for each hash; one that was added later may not
            own = own.join(run.hint("merge").select("hash", F.col("n_docs").alias(f"n{k}")), "hash", "left")
            known = known | F.col(f"n{k}").isNotNull()
        return own.select("hash", "n_docs", F.when(~known, F.col("holder")).alias("holder"))

    def add(self, batch: DataFrame) -> None:
        """Adds the batch's (id, hash), one row per document and hash."""
        self._push(self._written(self.anti_joined(batch)), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._written(self.merge(old))
            for run in old:
                drop_bucketed(run)
            self._push(merged, level + 1)

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.hint("merge").select("hash", F.col("n_docs").alias("n2"), F.col("holder").alias("h2"))
            both = a.join(b, "hash", "full")
            counts = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return both.select("hash", counts.alias("n_docs"), F.greatest("holder", "h2").alias("holder"))

        return reduce(two, runs)

    def close(self) -> None:
        for run in self.runs():
            drop_bucketed(run)
        self.levels = []


def _batch_edges(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    return sorted({int(x) for x in docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", shares, 0.01)})


def line_places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (id, digest, hash, place, first) of the lines that may be dropped; ``first`` marks a hash's first place in the text.

    The lines are put in order of hash, so that equal ones are neighbours; each text takes time by its length, however
    often a line is repeated.
    """
    text = whole_text(text_col)
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line_digest(line, min_chars).alias("h"), i.alias("place")))
    ordered = F.array_sort(F.filter(lines, lambda x: x["h"].isNotNull()))
    # inline() hands on the finished array; as a plain projection it would be made again for every element
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.inline(F.array(F.struct(F.xxhash64(text).alias("digest"), ordered.alias("ordered")))))
    before = lambda k: F.get("ordered", k - 1)["h"]
    marked = F.transform("ordered", lambda x, k: F.struct(x["h"].alias("h"), x["place"].alias("place"), (~before(k).eqNullSafe(x["h"])).alias("first")))
    return own.select("id", "digest", F.inline(marked)).select("id", "digest", F.unhex("h").alias("hash"), "place", "first")


def dropped_places(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """Rows (id, digest of the text, places of its dropped lines); stored."""
    spark = docs.sparkSession
    edges = _batch_edges(docs, id_col, batches)
    batch = F.lit(0)
    for edge in edges:
        batch = batch + F.when(F.col("id") >= edge, 1).otherwise(0)
    lines = stored(line_places(docs, id_col, text_col, min_chars).withColumn("batch", batch), "op6-lines", ["batch"])
    store = LineRuns(spark, fanout)
    for k in range(len(edges), -1, -1):
        store.add(lines.filter((F.col("batch") == k) & F.col("first")).select("id", "hash"))
    with _sorted_buckets(spark):
        repeated = stored(store.merge(store.runs()).filter(F.col("n_docs") >= min_docs), "op6-repeated")
    store.close()
    total = repeated.agg(F.sum("n_docs")).first()[0] or 0
    drops = join_by_class(lines.select("id", "digest", "hash", "place"), repeated, "hash", "n_docs", total, "inner").filter("id <> holder")
    drops = stored(drops.groupBy("id", "digest").agg(F.collect_set("place").alias("places")), "op6-drops")
    drop_stored(lines)
    drop_stored(repeated)
    return drops


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """The documents with all their columns, the text without dropped lines, and two columns more: n_lines and n_dropped.

    A line whose key has min_chars code points and stands in min_docs rows or more is dropped everywhere but in the
    largest id that holds it, where all its lines stay.  Null and empty texts have one empty line, and come out as
    the empty text.  A null id counts as the smallest.  Rows that repeat an id count as documents of their own, and
    keep a line together if the id is its largest.  Columns of any other name pass through; where the input has a column
    n_lines or n_dropped, the new one's name ends in underscores.  An empty table gives none.
    """
    drops = dropped_places(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    text, own, digest, slot, hit, lines, n_lines, n_dropped = unused(docs.columns, "text_", "id_", "digest_", "slot_", "hit_", "lines_", "n_lines", "n_dropped")
    bits = array_bits(drops.count(), ID_BITS)
    place = lambda i, d: F.pmod(F.xxhash64(i, d), F.lit(bits)) + 1
    pages = stored(bit_pages(drops.select(place("id", "digest").alias("slot"))), "op6-ids")
    rows = docs.withColumn(text, whole_text(text_col)).withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(digest, F.xxhash64(text))
    rows = with_bit(rows.withColumn(slot, place(own, digest)), pages, slot, hit)
    passing = rows.filter(~F.col(hit)).withColumn(n_lines, (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long"))
    passing = passing.withColumn(n_dropped, F.lit(0).cast("long")).withColumn(text_col, F.col(text))
    # what drops has grows with the input, so it is never broadcast
    met = rows.filter(F.col(hit)).alias("r").join(drops.hint("merge").alias("d"), (F.col(f"r.{own}") == F.col("d.id")) & (F.col(f"r.{digest}") == F.col("d.digest")), "left")
    whole = F.inline(F.array(F.struct(F.split(F.col(f"r.{text}"), "\n").alias(lines), F.coalesce("d.places", F.array().cast("array<int>")).alias(slot))))
    met = met.select(*(F.col(f"r.`{c}`") for c in docs.columns), whole)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(slot)), lambda i: F.get(lines, i))
    met = met.withColumn(n_lines, F.size(lines).cast("long")).withColumn(n_dropped, F.size(slot).cast("long")).withColumn(text_col, F.array_join(kept, "\n"))
    columns = [F.col(f"`{c}`") for c in [*docs.columns, n_lines, n_dropped]]
    return passing.select(*columns).unionByName(met.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.holder, false) AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
