"""Packing token sequences by the linear grouping scheme (de la Vega and Lueker, 1981) and best fit.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths
(at most ``capacity`` numbers) reaches the driver.  There the large lengths are dealt into groups of equal
cardinality and rounded up to the group's largest; configurations of these few sizes are optimised by a linear
programme with generated columns (Gilmore and Gomory, 1961); the actual lengths take the rounded ones' places;
whatever is left over, and the small lengths, go where they fit best.

The plan says, for ranges of ranks of each length, which sequences and which place they take.  Ranks are counted
without ordering a length as a whole: a piece's rank is its rank in a hash bucket plus the sizes of the buckets
before.  So a length that holds a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorelog.llm.common import stored, whole_text

CAPACITY = 1024
END_ID = 2
#: Lengths over capacity / x are large; the plan with the fewest sequences of these x counts.
LARGE = (2, 3, 6)
GROUPS = 32
LP_STEPS = 2000
#: Pieces that a rank bucket holds, about.
BUCKET_ROWS = 2_000
CACHE_WORDS = 400_000
LONG_WORD = 64
SLICE = 1 << 20

#: The vocabulary's published splitting pattern; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordCache(dict):
    """word -> its ids as little-endian 32-bit numbers.

    Words of up to LONG_WORD characters are remembered, in two generations: when the newer one is full it becomes the
    older one, and what stands only there is forgotten with the next.
    """

    def __init__(self, encode, limit: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Coder:
    """Ids of texts under a byte-level BPE vocabulary file of the tokenizers library.

    The pattern never lets a token cross from a non-blank to a blank, so words between single spaces are encoded once
    and remembered.  In a run of blanks all but the last are one stretch for the merges (all of them at the text's end),
    and the last belongs to what follows; so runs of any length never meet the pattern.  The BPE is tiktoken's on the
    same vocabulary (the ids are equal); texts that hold a special token's string go through the tokenizers library whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.first = WordCache(self._ids, 10_000)
        self.rest = WordCache(lambda word: self._ids(" " + word))
        self.blanks = WordCache(self._merged, 10_000)

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.core.encode_ordinary(text)).tobytes()

    def _merged(self, run: str) -> bytes:
        return array.array("I", self.core._encode_single_piece(run.encode())).tobytes()

    @functools.cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _words(self, text: str, out: list[bytes]) -> None:
        """Adds the ids of a stretch without neighbouring blanks, cut into a bounded number of words at a time."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + SLICE) if len(text) - at > SLICE else -1
            first, *rest = text[at : end if end >= 0 else len(text)].split(" ")
            if first:
                out.append(self.first[first])
            out += map(self.rest.__getitem__, rest)
            if end < 0:
                return
            at = end

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out: list[bytes] = []
        at = 0
        for run in _RUN.finditer(text):
            self._words(text[at : run.start()], out)
            at = run.end() if run.end() == len(text) else run.end() - 1
            out.append(self.blanks[text[run.start() : at]])
        self._words(text[at:], out)
        return b"".join(out)


#: Neighbouring blanks; the pattern's blanks are those of Unicode's property White_Space, a fixed value.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what the others leave."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and, if asked for, the ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = encode(text.as_py()) + end
                    for k, (at, n) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                        ids = raw[4 * at : 4 * (at + n)]
                        out.append((doc_id, k, at, n, zlib.crc32(ids), np.frombuffer(ids, dtype=np.int32) if with_ids else None))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


# --- the plan ----------------------------------------------------------------------------------------------


def linear_groups(histogram: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)]) of groups of equal cardinality, from the largest lengths down.

    Groups with the same rounded size are one.
    """
    total = sum(c for _, c in histogram)
    share = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, count in sorted(histogram, reverse=True):
        while count:
            if not room:
                room = share
                if not out or out[-1][0] != length:
                    out.append((length, []))
            take = min(room, count)
            out[-1][1].append((length, take))
            room, count = room - take, count - take
    return out


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of sizes that fits."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for c in range(smallest, capacity + 1):
        fits = c - sizes
        got = np.where(fits >= 0, best[fits], -np.inf) + values
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[k], k
        else:
            best[c] = best[c - 1]
    config, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        config[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return float(best[capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = LP_STEPS) -> list[tuple[int, list[int]]]:
    """(times, copies of each size) of the whole parts of an optimal basic solution of the configuration LP."""
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(steps):
        duals = np.linalg.solve(basis.T, np.ones(len(s)))
        value, config = _best_configuration(s, duals, capacity)
        if value <= 1 + 1e-7:
            break
        x, move = np.linalg.solve(basis, d), np.linalg.solve(basis, config)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = config
    x = np.linalg.solve(basis, d)
    return [(int(n + 1e-6), [int(round(v)) for v in basis[:, k]]) for k, n in enumerate(x) if n >= 1 - 1e-6]


class Plan:
    """Placements (length, first rank, count, first sequence, offset): rank r goes to sequence first + r - first rank."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.next_rank: dict[int, int] = defaultdict(int)
        #: room left -> stretches (first sequence, count) of sequences with that room
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        self.rows.append((length, self.next_rank[length], count, first, offset))
        self.next_rank[length] += count

    def fill(self, times: int, slots: list[list[tuple[int, int]]]) -> None:
        """New sequences, alike but for the lengths in each slot, which are given as runs (length, count) over all of them."""
        at = 0
        runs = [list(reversed(r)) for r in slots]
        while at < times:
            step = min(r[-1][1] for r in runs)
            offset = 0
            for r in runs:
                length, count = r.pop()
                self.place(length, step, self.sequences + at, offset)
                offset += length
                if count > step:
                    r.append((length, count - step))
            self.open[self.capacity - offset].append((self.sequences + at, step))
            at += step
        self.sequences += times

    def best_fit(self, length: int, count: int) -> None:
        while count:
            room = next((r for r in range(length, self.capacity) if self.open.get(r)), None)
            if room is None:
                self.open[self.capacity].append((self.sequences, -(-count // (self.capacity // length))))
                self.sequences += self.open[self.capacity][-1][1]
                room = self.capacity
            first, n = self.open[room].pop()
            take = min(n, count)
            self.place(length, take, first, self.capacity - room)
            if n > take:
                self.open[room].append((first + take, n - take))
            if room > length:
                self.open[room - length].append((first, take))
            count -= take
            if room == self.capacity and count:  # further copies of the same length go on top
                continue


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple = LARGE) -> Plan:
    """The best of the plans with each bound between large and small lengths."""
    return min((_plan(histogram, capacity, groups, capacity / x) for x in large), key=lambda plan: plan.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, bound: float) -> Plan:
    plan = Plan(capacity)
    if full := histogram.get(capacity, 0):
        plan.fill(full, [[(capacity, full)]])
    large = [(n, c) for n, c in histogram.items() if bound < n < capacity]
    grouped = linear_groups(large, groups)
    left = [list(items) for _, items in grouped]
    for times, config in configurations([size for size, _ in grouped], [sum(c for _, c in items) for _, items in grouped], capacity):
        slots = []
        for g, copies in enumerate(config):
            for _ in range(copies):
                runs, need = [], times
                while need:
                    length, count = left[g][0]
                    take = min(need, count)
                    runs.append((length, take))
                    need -= take
                    if take == count:
                        left[g].pop(0)
                    else:
                        left[g][0] = (length, count - take)
                slots.append(runs)
        plan.fill(times, slots)
    rest: dict[int, int] = defaultdict(int)
    for items in left:
        for length, count in items:
            rest[length] += count
    for length, count in histogram.items():
        if length <= bound and length < capacity:
            rest[length] += count
    for length in sorted(rest, reverse=True):
        plan.best_fit(length, rest[length])
    return plan


# --- operator ----------------------------------------------------------------------------------------------


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with ``rank``, from 0 and gapless within each length; a length has a bucket for BUCKET_ROWS pieces."""
    spark = pieces.sparkSession
    many = spark.createDataFrame([(n, max(1, -(-c // BUCKET_ROWS))) for n, c in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    inside = dealt.withColumn("own", F.row_number().over(own) - 1)
    return inside.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "before", "own")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece of the end id alone.  Texts of any length, and runs of blanks of any length, are
    encoded whole.  Repeated rows are packed each on its own; rows without an id too.  Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = stored(token_pieces(docs, id_col, text_col, path, capacity, end_id, with_ids), "op2-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity)
    places = spark.createDataFrame(plan.rows, "length long, first_rank long, places long, first_sequence long, offset long")
    # the plan's size depends on capacity and GROUPS, not on the number of pieces
    here = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("places"))
    p, q = ranked(pieces, histogram).alias("p"), F.broadcast(places).alias("q")
    joined = p.join(q, (F.col("p.length") == F.col("q.length")) & here)
    return joined.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset", *(["ids"] if with_ids else [])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: SQL has no tokenizer; the query is tested against brute force.
SQL = None
