"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every normalised text to one slot of a bit array and keeps the slots that were hit twice or more; a row
whose slot nobody else hit is unique and passes straight through.  Pass 2 does the same, with another hash, for the
rows that are left.  Only what both passes keep shuffles, to be grouped by the SHA-256 of the normalised text, so a
false positive costs a little work and never a wrong answer.

DataFrame functions only.  An array has about BITS_PER_ROW bits a row, so about one unique row in 16 passes pass 1 and
one in 250 both, whatever the number of rows.  Arrays are broadcast, so they have RANGE_BITS bits (32 MB) at most;
over RANGE_BITS / BITS_PER_ROW rows the hashes are dealt into ranges, which go through the passes one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import array_bits, bit_pages, drop_stored, join_by_class, stored, unused, whole_text, with_bit

RANGE_BITS = 1 << 28
#: Up to so many (id, hash) pairs, about 100 bytes each, are broadcast to the documents.
NEAR_ROWS = 500_000


def normalised(col: str = "text") -> Column:
    """Null counts as empty; each run of the six ASCII blanks becomes one space."""
    return F.regexp_replace(whole_text(col), "[\\x20\\x09-\\x0D]+", " ")


def _slot(bits: int, turn: int) -> Column:
    """From 1 on, as the bitmap functions count."""
    return F.pmod(F.xxhash64("text_sha256", F.lit(turn)), F.lit(bits)) + 1


def repeated_slots(hashes: DataFrame, bits: int, turn: int) -> DataFrame:
    """Rows (page, bitmap) of the slots hit at least twice.  Only slot numbers shuffle, one a row, summed map-side."""
    return bit_pages(hashes.select(_slot(bits, turn).alias("slot")).groupBy("slot").count().filter("count > 1"))


def possibly_repeated(hashes: DataFrame, pages: DataFrame, bits: int, turn: int) -> DataFrame:
    """The rows with a column ``maybe``, false only where no other row has the same text."""
    return with_bit(hashes.withColumn("slot", _slot(bits, turn)), pages, "slot", "maybe").drop("slot")


def sifted(hashes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One pass: the rows that are unique, and the rows that may be repeated; both are stored."""
    bits = array_bits(hashes.count())
    pages = stored(repeated_slots(hashes, bits, turn), "op8-filter")
    tested = stored(possibly_repeated(hashes, pages, bits, turn), "op8-tested", ["maybe"])
    drop_stored(pages)
    return tested.filter("not maybe").drop("maybe"), tested.filter("maybe").drop("maybe")


def _groups(hashes: DataFrame) -> DataFrame:
    """The result's rows of one range of hashes."""
    unique, left = sifted(hashes, 0)
    also_unique, left = sifted(left, 1)
    alone = unique.unionByName(also_unique).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", F.lit(False).alias("maybe")
    )
    groups = stored(left.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "op8-groups")
    joined = join_by_class(left, groups, "text_sha256", "group_size", left.count(), "inner")
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", F.lit(True).alias("maybe")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, maybe (whether the row shuffled).

    Null and empty texts are one group.  Other columns are ignored, whatever their names.  Rows that repeat
    the smallest id of their group are all marked kept, as they can't be told apart; a null id loses to any
    other id, and a group of null ids alone keeps them all (keep_id null).  An empty table gives no rows.
    """
    hashes = stored(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256")), "op8-hashes")
    ranges = -(-array_bits(hashes.count()) // RANGE_BITS)
    if ranges == 1:
        return _groups(hashes)
    dealt = stored(hashes.withColumn("hash_range", F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(ranges)).cast("int")), "op8-ranges", ["hash_range"])
    drop_stored(hashes)
    out = None
    for k in range(ranges):
        part = stored(_groups(dealt.filter(F.col("hash_range") == k).drop("hash_range")), "op8-result")
        out = part if out is None else out.unionByName(part)
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group of equal texts: that with the smallest id.

    An id loses to a smaller one, a null id to any; null and empty texts are one group.  A row goes by its id and text
    together, so rows that share an id and differ in text are judged apart, with or without an id.  Of rows that repeat
    both the kept id and the text, any one stays.  Other columns pass through, whatever their names.
    """
    found = exact_groups(docs, id_col, text_col).filter("maybe")
    own, sha, gone, again = unused(docs.columns, "id", "sha", "gone", "again")
    pairs = stored(found.groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).agg((~F.first("kept")).alias(gone), (F.count(F.lit(1)) > 1).alias(again)), "op8-pairs")
    pairs = stored(pairs.filter(F.col(gone) | F.col(again)), "op8-pairs")
    if pairs.count() <= NEAR_ROWS:
        pairs = F.broadcast(pairs)
    rows, pairs = docs.withColumn(sha, F.sha2(normalised(text_col), 256)).alias("d"), pairs.alias("p")
    same = F.col(f"d.{sha}").eqNullSafe(F.col(f"p.{sha}")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col(f"p.{own}"))
    joined = rows.join(pairs, same, "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    joined = joined.select("d.*", F.coalesce(F.col(again), F.lit(False)).alias(again))
    single = joined.filter(F.col(again)).dropDuplicates([id_col, sha])
    return joined.filter(~F.col(again)).unionByName(single).drop(sha, again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         sha256(norm) AS text_sha256
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
