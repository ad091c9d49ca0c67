"""SimHash near-dedup by tiled exact comparison.

Fingerprints (64 bits a word; one word or several) are dealt into tiles by the population counts of their
segments.  Two fingerprints within ``radius`` bits have segment counts within ``radius`` in sum, so a tile meets
only the tiles whose counts are that near; the other tile pairs are skipped, and no link is lost.  A pair of
tiles is compared by numpy exclusive-or and bit counts and gives the links that join something, at most one less
than its rows, never all pairs of a group.  Components of the links are found by distributed star contraction.

With four segments a tile meets 41 of up to 83,521 kinds of tile (about 1.6 % of all pairs).  For more fingerprints the
segments are more and narrower (``segments_for``), so that a tile stays about as full and meets a smaller part of the
others; no link is lost with any number of them.  Sets of shingles have a size besides: sets of a similarity s have
sizes within a factor of s, so a tile of sets meets only the tiles of its own and the neighbouring classes of size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import components, join_by_class, stored, unused

SHINGLE = 3
RADIUS = 2
#: (fingerprints, segments): with more fingerprints, more segments.
SEGMENTS = ((0, 4), (1 << 22, 8), (1 << 28, 16))
TILE = 4096
SEED = 42
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Rows of a tile that meet the whole of another at a time.
STRIP = 64
#: Words of a wide fingerprint that the sieve compares.
SIEVE_WORDS = 2
#: Up to so many shingles in the union, a bit's chance to differ is summed up exactly.
SMALL_UNION = 60
#: Rows, and bytes of shingle hashes, of a block of candidates.
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of the text, a bounded number at a time; only A-Z are lower-cased."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].lower().split()
        at = end


def shingle_hashes(raw: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence if it is shorter."""
    carry: list[bytes] = []
    some = False
    for words in word_slices(raw):
        words = carry + words
        if len(words) >= k:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
            yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
            some = True
            carry = words[len(words) - k + 1 :] if k > 1 else []
        else:
            carry = words
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The shingle's hash for a further word of the fingerprint (word 0 is the hash itself)."""
    if not word:
        return h
    x = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(raw: bytes | None, k: int = SHINGLE, words: int = 1) -> bytes:
    """A bit is 1 if it is set in over half the shingle hashes, repeats included; no words give zero."""
    return _majority(shingle_hashes(raw or b"", k), words)


def _majority(hashes: Iterable[np.ndarray], words: int) -> bytes:
    ones = np.zeros(64 * words, dtype=np.int64)
    n = 0
    for h in hashes:
        n += len(h)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)]
            for w in range(words):
                bits = np.unpackbits(_mixed(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[64 * w : 64 * w + 64] += bits.sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, words: int) -> DataFrame:
    """Rows (doc_id, fp): fp has 8 bytes a word, the least significant first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), k, words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp binary")


def segments_for(n: int) -> int:
    return max(segments for least, segments in SEGMENTS if n >= least)


def _half_offsets(segments: int, reach: int) -> list[list[int]]:
    """Zero, and one of each pair of opposite offsets, of the vectors with a sum of sizes up to reach."""
    near = [((), 0)]
    for _ in range(segments):
        near = [((*v, x), used + abs(x)) for v, used in near for x in range(used - reach, reach - used + 1)]
    return [list(v) for v, _ in near if v >= (0,) * segments]


def _tile_arrays(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """One list of (fp, node): the fingerprints as (n, words) and the nodes."""
    rows = column.values if isinstance(column, pa.ListScalar) else column
    fp, node = rows.field("fp"), rows.field("node")
    return np.frombuffer(b"".join(fp.to_pylist()), dtype=np.uint64).reshape(len(fp), -1)[:, :words], node.to_numpy(zero_copy_only=False)


def tile_links(
    a: np.ndarray, b: np.ndarray | None, radius: int, sieve: int, sieve_words: int = 1, sure: Callable[[int, int], bool] | None = None
) -> Iterator[tuple[int, int]]:
    """Links (row of a, row of b) that join what the links before have not joined; b None: a with itself.

    ``sieve`` bounds the distance of the first ``sieve_words`` words, which is cheap; ``radius`` the whole distance.  With ``sure`` a pair is a link only if it says so, and every pair that is not yet joined is asked for.
    """
    own = b is None
    b = a if own else b
    n = len(a)
    label = np.arange(n if own else n + len(b))
    shift = 0 if own else n
    heads = np.ascontiguousarray(b[:, :sieve_words].T)
    for at in range(0, n, STRIP):
        strip = a[at : at + STRIP]
        near = sum(np.bitwise_count(strip[:, w : w + 1] ^ heads[w]) for w in range(sieve_words)) <= sieve
        if own:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(strip))[:, None]
        i, j = np.nonzero(near)
        if len(i) and a.shape[1] > 1:
            keep = np.zeros(len(i), dtype=bool)
            for c in range(0, len(i), 1 << 17):
                d = np.bitwise_count(strip[i[c : c + (1 << 17)]] ^ b[j[c : c + (1 << 17)]]).sum(axis=1, dtype=np.int32)
                keep[c : c + (1 << 17)] = d <= radius
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        for row in np.unique(i):
            others = j[i == row] + shift
            if sure:
                others = others[label[others] != label[at + row]]
                while len(others):
                    if sure(int(at + row), int(others[0] - shift)):
                        yield int(at + row), int(others[0] - shift)
                        label[label == label[others[0]]] = label[at + row]
                    others = others[1:]
                    others = others[label[others] != label[at + row]]
                continue
            kinds, first = np.unique(label[others], return_index=True)
            mine = label[at + row]
            new = kinds != mine
            if new.any():
                for f in first[new]:
                    yield int(at + row), int(others[f] - shift)
                label[np.isin(label, kinds[new])] = mine


def links(classes: DataFrame, words: int, radius: int, segments: int, tile: int, sieve: int, sieve_words: int = 1, similarity: float | None = None) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints are within radius; classes: (fp, node), fps differ.

    Bytes of fp beyond ``words`` words only tell classes apart.  With ``similarity`` and a column ``members``, the sizes of
    the sets, nodes whose sizes are too different for it are not compared.
    """
    width = 64 * words // segments
    step = 1 if segments > 1 else radius + 1  # one segment: counts are dealt into strips as wide as the reach
    reach = radius if segments > 1 else 1
    digits = F.hex("fp")
    nibbles = width // 4
    # the bytes are little-endian, but any fixed cut of the bits into segments will do
    counts = [
        sum((F.bit_count(F.conv(F.substring(digits, 1 + s * nibbles + c, min(8, nibbles)), 16, 10).cast("long")) for c in range(0, nibbles, 8)), F.lit(0))
        for s in range(segments)
    ]
    counts = [F.floor(c / step).cast("int") for c in counts]
    if similarity:  # a class of size spans a factor of the similarity, with room for rounding
        counts.append(F.floor(F.log(F.greatest("members", F.lit(1)).cast("double")) / -math.log(similarity - 1e-6)).cast("int"))
    keyed = classes.select("fp", "node", F.array(*counts).alias("key"))
    keyed = stored(keyed, "op3-keys")
    # at most (width + 1) ** segments keys, whatever the number of rows
    kinds = stored(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")), "op3-kinds")
    dealt = keyed.join(F.broadcast(kinds), "key").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks")).cast("int"))
    tiles = stored(dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("fp", "node")).alias("rows")), "op3-tiles")
    offsets = _half_offsets(segments, reach)
    if similarity:
        offsets = [[*v, size] for v in product(range(-reach, reach + 1), repeat=segments) if sum(map(abs, v)) <= reach for size in (-1, 0, 1) if (*v, size) >= (0,) * (segments + 1)]
    offsets = F.array(*(F.array(*map(F.lit, v)) for v in offsets))
    guests = tiles.select(F.col("key").alias("own"), F.col("chunk").alias("own_chunk"), F.col("rows").alias("guest"), F.explode(offsets).alias("offset"))
    guests = guests.withColumn("key", F.zip_with("own", "offset", lambda x, y: x + y)).join(F.broadcast(kinds), "key")
    same = F.col("key") == F.col("own")
    guests = guests.withColumn("chunk", F.explode(F.sequence(F.when(same, F.col("own_chunk")).otherwise(0), F.col("chunks") - 1)))
    alone = same & (F.col("chunk") == F.col("own_chunk"))
    guests = guests.filter(~(alone & (F.size("guest") < 2))).select("key", "chunk", "guest", alone.alias("alone"))
    pairs = guests.join(tiles, ["key", "chunk"]).select("rows", F.when(~F.col("alone"), F.col("guest")).alias("guest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, nodes = _tile_arrays(batch.column(0)[k], words)
                other = batch.column(1)[k]
                b, nodes_b = _tile_arrays(other, words) if other.is_valid else (None, nodes)
                found = list(tile_links(a, b, radius, sieve, sieve_words))
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i], pa.int64()), pa.array(nodes_b[j], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def flip_chance(common: int, own_a: int, own_b: int) -> float:
    """The probability that a fingerprint's bit differs between sets with so many common shingles and so many of their own."""
    over = lambda own, s: sum(math.comb(own, i) for i in range(own + 1) if 2 * (s + i) > common + own) / 2**own
    both = [(math.comb(common, s) / 2**common, over(own_a, s), over(own_b, s)) for s in range(common + 1)]
    return sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in both)


@functools.cache
def wide_radius(similarity: float, words: int, miss: float = 1e-6) -> tuple[int, int]:
    """(radius, sieve on the first SIEVE_WORDS words): each passes pairs of at least this Jaccard similarity but for a
    chance of ``miss``.

    A bit differs with probability angle / pi, with cosine 2s / (1 + s) at similarity s; that is the limit for many
    shingles, and the exact chance is taken where it is greater, over all pairs of small sets.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for union in range(2, SMALL_UNION + 1):
        for own in range(1, int(union * (1 - similarity) + 1e-9) + 1):
            chance = max([chance] + [flip_chance(union - own, x, own - x) for x in range(own // 2 + 1)])

    def reach(bits: int) -> int:
        left, r = 1.0, -1
        while left > miss:
            r += 1
            left -= math.comb(bits, r) * chance**r * (1 - chance) ** (bits - r)
        return r

    return reach(64 * words), reach(64 * SIEVE_WORDS)


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    words: int = 1,
    radius: int = RADIUS,
    segments: int | None = None,
    tile: int = TILE,
    sieve: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, fp (binary), component_id (the smallest id reachable by links).

    Null and empty texts have the fingerprint zero and are linked like any other.  A row without an id has a
    fingerprint, but links nothing and has no component.  Rows that repeat an id are one node per fingerprint, so
    links through either join.  Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, k, words), "op3-prints")
    known = prints.filter(F.col("doc_id").isNotNull())
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")), "op3-classes")
    total = prints.count()
    found = links(classes, words, radius, segments or segments_for(total), tile, radius if sieve is None else sieve)
    # an id that stands in several classes joins them
    twice = known.groupBy("doc_id").agg(F.count_distinct("fp").alias("fps")).filter("fps > 1").select("doc_id")
    again = known.join(twice, "doc_id").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(found.unionByName(again), "op3-links")
    named = classes.join(joined, "node", "left").select("fp", "size", F.coalesce("component", "node").alias("component_id"))
    named = stored(named, "op3-named")
    out = join_by_class(known, named, "fp", "size", total, "inner").select("doc_id", "fp", "component_id")
    return out.unionByName(prints.filter(F.col("doc_id").isNull()).select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def shingle_set(raw: bytes | None, k: int) -> np.ndarray:
    """The different shingle hashes of the text, ascending."""
    found = list(shingle_hashes(raw or b"", k))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have at least this Jaccard similarity; two empty ones are equal."""
    few, many = sorted((len(x), len(y)))
    if few < similarity * many - 1e-9:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (few + many - common) - 1e-9


def set_prints(docs: DataFrame, id_col: str, text_col: str, k: int, words: int, whole: bool = False) -> DataFrame:
    """Rows (doc_id, fp, members), with ``whole`` also the set: fp has ``words`` words of fingerprint and two of the set's digest.

    Each different shingle counts once, as the similarity is one of sets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, prints, sizes = [], [], []
                for raw in part.column(1):
                    hashes = shingle_set(raw.as_py(), k)
                    sizes.append(len(hashes))
                    prints.append(_majority([hashes], words) + xxhash.xxh3_128_digest(hashes.tobytes()))
                    if whole:
                        sets.append(hashes.tobytes())
                arrays = [part.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())] + ([pa.array(sets, pa.binary())] if whole else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "members", "set"][: len(arrays)])

    return rows.mapInArrow(run, "doc_id long, fp binary, members long" + (", set binary" if whole else ""))


def sure_links(sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between rows (node, fp, set, component) of one component whose sets have the similarity.

    A component is dealt into blocks of bounded rows and bytes, and every block meets itself and the blocks after it, so
    no large component lands in one task.
    """
    radius, sieve = wide_radius(similarity, words)
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("set")).alias("bytes"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    many = stored(sizes.filter("blocks > 1"), "op3-blocks")
    # a block has BLOCK_ROWS rows or BLOCK_BYTES, so the components with several are few beside the rows
    dealt = sets.join(F.broadcast(many), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "fp"), F.col("blocks")).cast("int"))
    blocks = stored(dealt.groupBy("component", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("fp", "node", "set")).alias("rows")), "op3-candidates")
    guests = blocks.filter("blocks > 1 or size(rows) > 1").select(
        "component", F.col("block").alias("own"), F.col("rows").alias("guest"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block")
    )
    alone = guests.filter("own = block").select("guest", F.lit(None).cast(guests.schema["guest"].dataType).alias("rows"))
    across = guests.filter("own <> block").join(blocks, ["component", "block"]).select("guest", "rows")

    def sets_of(rows: pa.ListScalar) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=np.uint64) for x in rows.values.field("set").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, other in zip(batch.column(0), batch.column(1)):
                a, nodes = _tile_arrays(mine, words)
                b, nodes_b = _tile_arrays(other, words) if other.is_valid else (None, nodes)
                own = sets_of(mine)
                theirs = sets_of(other) if other.is_valid else own
                found = list(tile_links(a, b, radius, sieve, SIEVE_WORDS, lambda x, y: alike(own[x], theirs[y], similarity)))  # noqa: B023
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i], pa.int64()), pa.array(nodes_b[j], pa.int64())], ["a", "b"])

    return alone.unionByName(across).mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, words: int = 16, tile: int = 8192) -> DataFrame:
    """The documents with all their columns, one row (of the smallest id) of each group of near copies.

    Near means a Jaccard similarity of at least ``similarity`` between sets of k-word shingles; texts without a word are
    alike.  Fingerprints of 64 * words bits name the candidates (a near pair is missed with a chance of a few in a
    million), and the candidates' shingle sets, made again from their texts, decide.  Rows that share an id are one
    document: they join the groups of all their texts, and of the id that stays one row stays (that of the least text
    hash; any one of equal rows).  Rows without an id stay.  Other columns pass through, whatever their names; an empty
    table gives no rows.
    """
    node, gone_id, digest, least = unused(docs.columns, "node", "gone_id", "digest", "least")
    own_id = F.col(id_col).cast("long")
    prints = stored(set_prints(docs, id_col, text_col, k, words).filter("doc_id is not null"), "op3-prints")
    total = prints.count()
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("members").alias("members"))
    classes = stored(classes, "op3-classes")
    radius, sieve = wide_radius(similarity, words)
    found = links(classes.select("fp", "node", "members"), words, radius, 1, tile, sieve, SIEVE_WORDS, similarity)
    maybe = stored(components(found, "op3-links"), "op3-maybe")
    texts = docs.join(maybe.select(F.col("node").alias(node)), own_id == F.col(node), "left_semi")
    sets = set_prints(texts, id_col, text_col, k, words, True).withColumnRenamed("doc_id", "node").join(maybe, "node")
    sets = stored(sets, "op3-sets")
    # an id that stands in several classes joins them
    rows_of = stored(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("fp").alias("fps")).filter("rows > 1"), "op3-repeats")
    again = prints.join(rows_of.filter("fps > 1").select("doc_id"), "doc_id").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(sure_links(sets, words, similarity).unionByName(again), "op3-links")
    named = classes.join(joined, "node", "left").select("fp", "size", F.coalesce("component", "node").alias("component_id"))
    found = join_by_class(prints, stored(named, "op3-named"), "fp", "size", total, "inner")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, own_id == F.col(gone_id), "left_anti")
    repeated = rows_of.select(F.col("doc_id").alias(gone_id))
    if rows_of.isEmpty():
        return kept
    single = kept.join(repeated, own_id == F.col(gone_id), "left_anti")
    several = kept.join(repeated, own_id == F.col(gone_id), "left_semi").withColumn(digest, F.xxhash64(text_col))
    first = several.groupBy(F.col(id_col).alias(gone_id)).agg(F.min(digest).alias(least))
    first = several.join(first, (F.col(id_col) == F.col(gone_id)) & (F.col(digest) == F.col(least))).dropDuplicates([id_col])
    return single.unionByName(first.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.hex("fp"))
    number = F.concat(*(F.substring(digits, at, 2) for at in range(15, 0, -2)))  # the most significant byte first
    return found.select("doc_id", number.alias("fingerprint"), "component_id")


#: SQL has no XXH64; the query is tested against brute force.
SQL = None
