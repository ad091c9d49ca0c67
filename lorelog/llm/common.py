"""What the operators share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorelog.storage import components, drop_stored, join_by_class, shared_root, stored

__all__ = ["BLANKS", "UPPER", "array_bits", "bit_pages", "bucketed", "components", "drop_bucketed", "drop_stored", "id_crc", "join_by_class", "lower_ascii", "stored", "unused", "whole_text", "with_bit"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white-space characters that the text contracts name.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a bit array for each entry, and in a bitmap of bitmap_construct_agg.
BITS_PER_ROW = 16
PAGE = 8 * 4096


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """CRC-32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (names of columns don't differ by case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def array_bits(rows: int, most: int | None = None) -> int:
    """Bits of a bit array for so many entries, in whole pages, ``most`` at most."""
    bits = max(1, -(-rows * BITS_PER_ROW // PAGE)) * PAGE
    return min(bits, most) if most else bits


def bit_pages(slots: DataFrame) -> DataFrame:
    """Rows (page, bitmap) of a bit array, from rows (slot); slots count from 1."""
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def with_bit(rows: DataFrame, pages: DataFrame, slot: str, name: str) -> DataFrame:
    """The rows with the bit at their slot (a column) as a boolean column; the pages, which are of bounded size, are broadcast."""
    page, at, bitmap, key = unused([*rows.columns, name], "page", "at", "bitmap", "key")
    own = F.broadcast(pages.select(F.col("page").alias(key), F.col("bitmap").alias(bitmap)))
    rows = rows.withColumn(page, F.expr(f"bitmap_bucket_number(`{slot}`)")).withColumn(at, F.expr(f"bitmap_bit_position(`{slot}`)"))
    rows = rows.join(own, F.col(page) == F.col(key), "left")
    byte = f"cast(conv(hex(substring({bitmap}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.withColumn(name, F.expr(f"coalesce(({byte} >> cast({at} % 8 as int)) & 1, 0) = 1")).drop(page, at, bitmap, key)


def bucketed(rows: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """The rows as a table of the shared folder, bucketed and sorted by the key, one file a bucket.  ``dealt``: the rows' plan
    has dealt them by the key already.

    There are as many buckets as shuffle partitions, so that a grouping or merge join by the key takes the buckets where
    they lie.  The table goes when the driver ends; ``drop_bucketed`` removes it earlier.
    """
    spark = rows.sparkSession
    table = f"lorelog_{name}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark).rstrip('/')}/lorelog/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows if dealt else rows.repartition(buckets, key)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._bucketed = (table, path)
    atexit.register(_at_exit, out)
    return out


def _at_exit(df: DataFrame) -> None:
    try:
        drop_bucketed(df)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def drop_bucketed(df: DataFrame) -> None:
    """Only for a table that no pending plan reads."""
    spark = df.sparkSession
    table, path = df._bucketed
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
