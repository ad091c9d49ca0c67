"""LM scoring: word counts of the whole corpus, and a log-bilinear model trained by noise-contrastive estimation.

Counts.  Every scan task counts its training tokens; the counts meet by word.  The VOCAB most frequent words (of at least
MIN_COUNT tokens) and their counts go to all tasks; every other word belongs to one of SUFFIXES classes by its last bytes.  Documents are dealt by hash into blocks of about BLOCK_BYTES, as numbers of words and classes, with the
words of the classes beside them.  For scoring, a block sends each of those words once and gets its count back, so what
is gathered grows with the corpus, no such word is asked for by more than one row a block, and none is broadcast.

Model (Mnih and Hinton, 2007; Mnih and Teh, 2012).  Words and classes have context vectors r and target vectors q with a
bias b.  The prediction from the CONTEXT tokens before is the sum of a_j * r_j (elementwise); its dot product with q plus
b is the log of the target's weight.  It is trained on all training tokens: in each of ROUNDS rounds every block goes
over its share of the documents in minibatches with shared noise words, from where the mean of all blocks stood after
the round before.  The sums over blocks are of whole numbers, so neither they nor anything else depends on how the rows
are laid out.

Scores are normalised exactly by a tree over the words, split by the target vectors into parts of equal mass: a token's
probability is that of its branch, times that of its leaf there, times that of the word in its leaf.  Branches and
leaves have the mean vector and the summed weight of their words; all of it is batched matrix products.  A word of a
suffix class is then drawn from its count: (c + 0.1) / (R + 0.1 (U + 1)), with R the tokens and U the distinct words of
the class, so that the probabilities of all words seen and one unseen word a class sum up to 1.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import bucketed, id_crc, stored, whole_text

#: The token that ends every text; no word holds a line break.
END = b"\n"
FOLDS = 10
ALPHA = 0.1
VOCAB = 1 << 15
MIN_COUNT = 3
SUFFIXES = 61
SUFFIX_BYTES = 3
DIM = 12
CONTEXT = 4
NOISE = 16
BATCH = 768
RATE = 0.11
ROUNDS = 4
SEED = 11
#: Splits of the tree of words down to a branch, and to a leaf.
BRANCH_SPLITS, LEAF_SPLITS = 5, 10
BLOCK_BYTES = 32 << 20
#: Bytes of text that are cut into words together, and tokens that are scored together.
CUT_BYTES = 16 << 20
RUN = 1 << 16
#: Parameters are summed as whole numbers of 1 / GRAIN, in so many slices.
GRAIN = 1 << 16
SLICES = 16


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts with A-Z lower-cased, one text behind the other, and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().cast(pa.binary())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0)
    if not pc.all(some, min_count=0).as_py():  # blanks at the ends leave empty words
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(some)
    return words, sizes


def _cuts(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a column, up to ``size`` bytes at a time or one larger value."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, column.slice(at, end - at)
        at = end


def _rows(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc(id_col) % folds == 0).alias("held_out"), whole_text(text_col).alias("raw"))


def token_counts(rows: DataFrame) -> DataFrame:
    """Rows (word, c) over the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for _, some in _cuts(batch.column(0), CUT_BYTES):
                yield pa.RecordBatch.from_struct_array(pc.value_counts(words_of(some)[0])).rename_columns(["word", "c"])
                pa.default_memory_pool().release_unused()  # workers live on for the stages after
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])

    parts = rows.filter("not held_out").select("raw").mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


# --- vocabulary ---


def suffix_classes(words: pa.Array) -> np.ndarray:
    """The last SUFFIX_BYTES bytes as a number, modulo SUFFIXES."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] else np.zeros(0, dtype=np.uint8)
    out = np.zeros(len(words), dtype=np.int64)
    for k in range(SUFFIX_BYTES, 0, -1):
        at = offsets[1:] - k
        has = at >= offsets[:-1]
        out[has] = out[has] * 256 + data[at[has]]
    return out % SUFFIXES


class Lexicon:
    """Numbers of words: the end has 0, then come the most frequent; a word outside has that of its suffix class, after them."""

    def __init__(self, words: list[bytes], counts: list[int], class_tokens: list[int], class_words: list[int]):
        self.words, self.counts, self.class_tokens, self.class_words = words, counts, class_tokens, class_words

    def __len__(self) -> int:
        return len(self.words)

    @functools.cached_property
    def class_sizes(self) -> np.ndarray:
        """R + 0.1 (U + 1) of each suffix class."""
        return np.array(self.class_tokens, dtype=np.float64) + ALPHA * (np.array(self.class_words, dtype=np.float64) + 1)

    @functools.cached_property
    def shares(self) -> np.ndarray:
        every = np.concatenate((np.maximum(np.array(self.counts, dtype=np.float64), ALPHA), self.class_sizes))
        return every / every.sum()

    def numbers(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its numbers, as 16-bit in a binary with the end's last, and its words of classes by line (null: none)."""
        words, sizes = words_of(texts)
        found = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.binary())), -1).to_numpy(zero_copy_only=False)
        ids = found.astype(np.uint16)
        outside = found < 0
        rest = words.filter(pa.array(outside))
        ids[outside] = len(self) + suffix_classes(rest)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes + 1)
        flat = np.zeros(len(ids) + len(sizes), dtype=np.uint16)
        flat[np.arange(len(ids)) + owner] = ids
        numbers = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, 2 * ends)), pa.py_buffer(flat)])
        per = np.bincount(owner[outside], minlength=len(sizes))
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int64()), rest.cast(pa.large_binary()))
        lines = pc.if_else(pa.array(per > 0), pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary())), pa.scalar(None, pa.large_binary()))
        return numbers.cast(pa.binary()), lines.cast(pa.binary())


def lexicon(counts: DataFrame, vocab: int) -> Lexicon:
    """From the stored counts; what the driver gathers is at most vocab words, the end, and SUFFIXES sums."""
    is_end = F.col("word") == F.lit(END)
    top = [(END, sum(r["c"] for r in counts.filter(is_end).collect()))]
    top += [(bytes(r["word"]), r["c"]) for r in counts.filter((F.col("c") >= MIN_COUNT) & ~is_end).orderBy(F.desc("c"), "word").limit(vocab).collect()]
    suffix = F.conv(F.hex(F.expr(f"substring(word, greatest(length(word) - {SUFFIX_BYTES - 1}, 1), {SUFFIX_BYTES})")), 16, 10).cast("long") % SUFFIXES
    sizes, kinds = [0] * SUFFIXES, [0] * SUFFIXES
    for r in counts.filter(~is_end).groupBy(suffix.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("u")).collect():
        sizes[r["k"]], kinds[r["k"]] = r["c"], r["u"]
    for word, c in top[1:]:
        k = int.from_bytes(word[-SUFFIX_BYTES:], "big") % SUFFIXES
        sizes[k] -= c
        kinds[k] -= 1
    return Lexicon([w for w, _ in top], [c for _, c in top], sizes, kinds)


def encoded(rows: DataFrame, words: Lexicon, blocks: int) -> DataFrame:
    """Rows (block, part, doc_id, digest, held_out, ids, rest), dealt by block: numbers as 16-bit, words of classes by line."""
    digest = F.xxhash64("doc_id", "raw")
    dealt = rows.select(F.pmod(digest, F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64(digest), F.lit(ROUNDS)).cast("int").alias("part"), "doc_id", digest.alias("digest"), "held_out", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _cuts(batch.column(5), CUT_BYTES // 4):
                own = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*own.columns[:5], *words.numbers(some)], ["block", "part", "doc_id", "digest", "held_out", "ids", "rest"])
            pa.default_memory_pool().release_unused()

    out = dealt.mapInArrow(run, "block int, part int, doc_id long, digest long, held_out boolean, ids binary, rest binary")
    return bucketed(out, "op4_encoded", "block")


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def flat_numbers(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts, one behind the other, and how many each has."""
    offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] // 2
    return np.frombuffer(ids.buffers()[2], dtype=np.uint16)[offsets[0] : offsets[-1]], np.diff(offsets)


# --- model ---


class Model:
    """Parameters of the log-bilinear model and the state of AdaGrad, over words and classes."""

    def __init__(self, shares: np.ndarray, start: int, dim: int = DIM, flat: np.ndarray | None = None):
        self.shares, self.start, self.dim = shares, start, dim
        n = len(shares)
        shapes = {"r": (n, dim), "q": (n, dim + 1), "a": (CONTEXT, dim), "grown_r": (n,), "grown_q": (n, 2), "grown_a": (CONTEXT, dim)}
        if flat is None:
            rng = np.random.default_rng(SEED)
            near = np.ones((CONTEXT, dim)) / np.arange(1, CONTEXT + 1)[:, None]
            first = [rng.normal(0, 0.1, (n, dim)), np.concatenate((rng.normal(0, 0.1, (n, dim)), np.log(shares)[:, None]), axis=1), near]
            flat = np.concatenate([*(x.ravel() for x in first), np.full(sum(math.prod(shapes[k]) for k in ("grown_r", "grown_q", "grown_a")), 1e-2)])
        self.flat = flat.astype(np.float32)
        self.parts, at = {}, 0
        for name, shape in shapes.items():
            self.parts[name] = self.flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)

    def guesses(self, before: np.ndarray) -> np.ndarray:
        """The predicted vector behind each row of contexts, with a 1 for the bias."""
        out = np.ones((before.shape[1], self.dim + 1), dtype=np.float32)
        out[:, :-1] = sum(self.weighed[j][before[j]] for j in range(CONTEXT))
        return out

    @functools.cached_property
    def weighed(self) -> list[np.ndarray]:
        """The context vectors at each place; for a model that no longer changes."""
        return [self.parts["r"] * self.parts["a"][j] for j in range(CONTEXT)]


def contexts(w: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT tokens before each token of texts of these sizes, nearest first; ``start`` stands in front of a text."""
    first = np.cumsum(sizes) - sizes
    before = np.full((CONTEXT, len(w)), start, dtype=w.dtype)
    for j in range(1, CONTEXT + 1):
        before[j - 1, j:] = w[:-j]
        for k in range(j):
            at = first + k
            before[j - 1, at[at < len(w)]] = start
    return before


def _sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different indices, sums of their rows)."""
    order = index.argsort(kind="stable")
    held = index[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return held[starts], np.add.reduceat(rows[order], starts)


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """NCE by AdaGrad over minibatches; each has NOISE noise words drawn from the shares."""

    def __init__(self, model: Model, seed: tuple[int, ...] = (SEED,)):
        self.model = Model(model.shares, model.start, model.dim, model.flat.copy())
        self.rng = np.random.default_rng(seed)
        self.ladder = np.cumsum(model.shares)
        self.noise = np.log(NOISE * model.shares).astype(np.float32)

    def fit(self, w: np.ndarray, sizes: np.ndarray) -> None:
        before = contexts(w, sizes, self.model.start)
        for k in self.rng.permutation(-(-len(w) // BATCH)):
            self.batch(before[:, k * BATCH : (k + 1) * BATCH], w[k * BATCH : (k + 1) * BATCH])

    def batch(self, before: np.ndarray, w: np.ndarray) -> None:
        p, dim, m = self.model.parts, self.model.dim, len(w)
        drawn = np.minimum(np.searchsorted(self.ladder, self.rng.random(NOISE)), len(self.ladder) - 1)
        seen = p["r"][before.ravel()].reshape(CONTEXT, m, dim)
        guess = np.ones((m, dim + 1), dtype=np.float32)
        np.einsum("jmd,jd->md", seen, p["a"], out=guess[:, :dim])
        target, other = p["q"][w], p["q"][drawn]
        right = _logistic(np.einsum("md,md->m", guess, target) - self.noise[w])
        other[:, dim] -= self.noise[drawn]
        wrong = _logistic(-(guess @ other.T))
        pull = target[:, :dim] * right[:, None]
        pull -= wrong @ other[:, :dim]
        i, grad = _sums(np.concatenate((w, drawn.astype(w.dtype))), np.concatenate((guess * right[:, None], -(wrong.T @ guess))))
        grown = p["grown_q"][i]
        grown[:, 0] += np.einsum("nd,nd->n", grad[:, :dim], grad[:, :dim]) / dim
        grown[:, 1] += grad[:, dim] ** 2
        p["grown_q"][i] = grown
        pace = RATE / np.sqrt(grown)
        grad[:, :dim] *= pace[:, :1]
        grad[:, dim] *= 0.3 * pace[:, 1]
        p["q"][i] += grad
        slope = np.einsum("md,jmd->jd", pull, seen) / m
        i, grad = _sums(before.ravel(), (pull[None] * p["a"][:, None, :]).reshape(-1, dim))
        grown = p["grown_r"][i] + np.einsum("nd,nd->n", grad, grad) / dim
        p["grown_r"][i] = grown
        grad *= (RATE / np.sqrt(grown))[:, None]
        p["r"][i] += grad
        p["grown_a"] += slope * slope
        p["a"] += 0.1 * RATE * slope / np.sqrt(p["grown_a"])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 32 bits where they fit, else in 64."""
    return x.astype(np.int32 if np.abs(x).max(initial=0) < 1 << 31 else np.int64).tobytes()


def _whole(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * n else np.int64)


def _added(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of rows (slice, n, sums) by slice, one row after the other."""
    held: dict[int, list] = {}
    for batch in batches:
        for k, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            own = held.setdefault(k, [0, np.zeros(sizes[k], dtype=np.int64)])
            own[0] += n
            own[1] += _whole(raw, sizes[k])
    columns = [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([_packed(x) for _, x in held.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["slice", "n", "sums"])


def train(docs: DataFrame, model: Model, round_no: int) -> Model:
    """The mean of the parameters that the blocks reach on their documents of this round; the driver gets one model."""
    cuts = [len(model.flat) * k // SLICES for k in range(SLICES + 1)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    schema = "slice int, n long, sums binary"

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        trainer = Trainer(model, (SEED, round_no, table.column("block")[0].as_py()))
        trainer.fit(*flat_numbers(_joined(table.column("ids"))))
        whole = np.rint(trainer.model.flat.astype(np.float64) * GRAIN).astype(np.int64)
        return pa.table([pa.array(range(SLICES), pa.int32()), pa.array([1] * SLICES, pa.int64()), pa.array([_packed(whole[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["slice", "n", "sums"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _added(batches, sizes):
            means = [_whole(raw, sizes[k]) / (GRAIN * n) for k, n, raw in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.float32).tobytes() for x in means], pa.binary())], ["slice", "n", "sums"])

    own = docs.filter((F.col("part") == round_no) & ~F.col("held_out")).select("block", "doc_id", "digest", "ids")
    found = own.groupBy("block").applyInArrow(fit, schema).repartition(SLICES, "slice").mapInArrow(mean, schema).collect()
    if not found:
        return model
    flat = model.flat.copy()
    for r in found:
        flat[cuts[r["slice"]] : cuts[r["slice"] + 1]] = np.frombuffer(r["sums"], dtype=np.float32)
    return Model(model.shares, model.start, model.dim, flat)


# --- scores ---


def _split(rows: np.ndarray, vectors: np.ndarray, mass: np.ndarray, depth: int) -> list[np.ndarray]:
    """The rows cut into halves of equal mass along their widest direction, ``depth`` times."""
    if not depth or len(rows) < 2:
        return [rows]
    m = mass[rows] / mass[rows].sum()
    off = vectors[rows] - m @ vectors[rows]
    along = off @ np.linalg.eigh((off * m[:, None]).T @ off)[1][:, -1]
    order = rows[np.lexsort((rows, along))]
    cut = min(max(1, int(np.searchsorted(np.cumsum(mass[order]), mass[rows].sum() / 2)) + 1), len(rows) - 1)
    return _split(order[:cut], vectors, mass, depth - 1) + _split(order[cut:], vectors, mass, depth - 1)


def _pooled(q: np.ndarray) -> np.ndarray:
    """One vector with a bias for a set of them: the weighted mean, and the log of the summed weights."""
    top = q[:, -1].max()
    weights = np.exp(q[:, -1] - top)
    return np.append(weights @ q[:, :-1] / weights.sum(), top + np.log(weights.sum()))


class Scorer:
    """Normalised log10 probabilities by a tree over the words; suffix classes are branches of their own."""

    def __init__(self, model: Model, words: int):
        self.model = model
        q = model.parts["q"].astype(np.float64)
        # a branch: its leaves; a leaf: its words
        tops = _split(np.arange(words), q[:, :-1], model.shares, BRANCH_SPLITS) if words else []
        tree = [_split(top, q[:, :-1], model.shares, LEAF_SPLITS - BRANCH_SPLITS) for top in tops]
        pooled = [np.array([_pooled(q[leaf]) for leaf in leaves]) for leaves in tree]
        small = lambda rows: np.ascontiguousarray(np.asarray(rows).T, dtype=np.float32)
        n = len(q)
        self.branch, self.leaf, self.place = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.branches = small([*(_pooled(x) for x in pooled), *q[words:]])
        self.branch[words:] = np.arange(len(tree), len(tree) + n - words)
        self.leaves = [small(x) for x in pooled]
        self.words: list[np.ndarray] = []
        self.first_leaf: list[int] = []
        for k, leaves in enumerate(tree):
            self.first_leaf.append(len(self.words))
            for j, leaf in enumerate(leaves):
                self.branch[leaf], self.leaf[leaf], self.place[leaf] = k, len(self.words), np.arange(len(leaf))
                self.words.append(small(q[leaf]))

    @staticmethod
    def _choice(guess: np.ndarray, options: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Log of the softmax over the options (columns) at the one that was taken."""
        if options.shape[1] == 1:
            return np.zeros(len(guess), dtype=np.float32)
        scores = guess @ options
        if scores.max() > 60:
            scores -= scores.max(axis=1, keepdims=True)
        own = scores[np.arange(len(scores)), taken]
        np.exp(scores, out=scores)
        return own - np.log(scores.sum(axis=1))

    def log10(self, before: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's word or suffix class."""
        guess = self.model.guesses(before)
        out = self._choice(guess, self.branches, self.branch[w]).astype(np.float64)
        order = np.lexsort((self.leaf[w], self.branch[w]))
        order = order[self.branch[w[order]] < len(self.leaves)]
        sorted_w = w[order]
        guess = guess[order]
        found = np.zeros(len(order))
        bounds = np.searchsorted(self.branch[sorted_w], np.arange(len(self.leaves) + 1))
        for k, options in enumerate(self.leaves):
            part = slice(bounds[k], bounds[k + 1])
            if part.start < part.stop:
                found[part] = self._choice(guess[part], options, self.leaf[sorted_w[part]] - self.first_leaf[k])
        bounds = np.searchsorted(self.leaf[sorted_w], np.arange(len(self.words) + 1))
        place = self.place[sorted_w]
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            found[part] += self._choice(guess[part], self.words[k], place[part])
        out[order] += found
        return out / math.log(10)


def _pieces(before: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A very long text's tokens, RUN at a time."""
    for at in range(0, len(w), RUN):
        yield before[:, at : at + RUN], w[at : at + RUN]


@functools.lru_cache(maxsize=1)
def _scorer(flat: bytes, shares: bytes, start: int, words: int) -> Scorer:
    return Scorer(Model(np.frombuffer(shares), start, DIM, np.frombuffer(flat, dtype=np.float32)), words)


def asked_words(docs: DataFrame) -> DataFrame:
    """Rows (block, word): each word of a suffix class once a block."""

    def run(table: pa.Table) -> pa.Table:
        found = pc.unique(pc.split_pattern(_joined(table.column("rest")), b"\n").flatten())
        pa.default_memory_pool().release_unused()
        return pa.table({"block": pa.array(np.full(len(found), table.column("block")[0].as_py()), pa.int32()), "word": found.cast(pa.binary())})

    return docs.select("block", "rest").groupBy("block").applyInArrow(run, "block int, word binary")


def trained(docs: DataFrame, words: Lexicon) -> Model:
    model = Model(words.shares, 0)
    for k in range(ROUNDS):
        model = train(docs, model, k)
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, vocab: int = VOCAB, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id) mod folds isn't 0 (a null id counts as empty).  Null and empty texts are the
    end token alone.  Equal texts get equal scores up to rounding; the order and the number of partitions of the rows
    change nothing.  Other columns are ignored, whatever their names; an empty table gives no rows.  With no training
    rows all counts are 0.
    """
    rows = _rows(docs, id_col, text_col, folds)
    counts = stored(token_counts(rows), "op4-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"])
    words = lexicon(counts, vocab)
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    dealt = encoded(rows, words, max(1, -(-size // block_bytes)))
    model = trained(dealt, words)
    key = (model.flat.tobytes(), model.shares.tobytes(), model.start, len(words))
    base_size = n + ALPHA * (v + 1)
    told = asked_words(dealt).join(counts, "word").select("block", "word", "c")

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        scorer = _scorer(*key)
        table = table.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        once = np.log10(np.concatenate((np.array(words.counts, dtype=np.float64), np.zeros(SUFFIXES))) + ALPHA)
        is_known = np.concatenate((np.array(words.counts) > 0, np.zeros(SUFFIXES, dtype=bool))).astype(np.int64)
        of_class = np.log10(words.class_sizes)
        ids, rest = _joined(table.column("ids")), _joined(table.column("rest"))
        # one look-up for the whole block, as its table is made anew each time
        told, times = known.column("word").combine_chunks(), np.append(known.column("c").to_numpy(), 0).astype(np.float64)
        rare = pc.split_pattern(rest, b"\n")
        counts_there = times[pc.fill_null(pc.index_in(rare.flatten(), value_set=told), len(times) - 1).to_numpy(zero_copy_only=False)]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False))
        del rare, told, known
        pa.default_memory_pool().release_unused()
        found: dict[str, list[np.ndarray]] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for at, some in _cuts(ids, 2 * RUN):
            w, sizes = flat_numbers(some)
            first = np.cumsum(sizes) - sizes
            outside = np.flatnonzero(w >= len(words))
            c = counts_there[ends[at - 1] if at else 0 : ends[at + len(some) - 1]]
            one, seen = once[w], is_known[w]
            one[outside], seen[outside] = np.log10(c + ALPHA), c > 0
            lp = np.concatenate([scorer.log10(x, y) for x, y in _pieces(contexts(w, sizes, model.start), w)])
            lp[outside] += one[outside] - of_class[w[outside] - len(words)]
            found["n_tokens"].append(sizes.astype(np.int64))
            found["n_known"].append(np.add.reduceat(seen, first))
            found["base_score"].append(np.add.reduceat(one, first) - sizes * math.log10(base_size))
            found["score"].append(np.add.reduceat(lp, first))
        out = {k: np.concatenate(v) for k, v in found.items()}
        done = {"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": out["n_tokens"], "n_known": out["n_known"]}
        return pa.table(done | {"train_tokens": np.full(table.num_rows, n), "base_score": out["base_score"], "score": out["score"]})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    inputs = dealt.select("block", "doc_id", "digest", "held_out", "ids", "rest")
    return inputs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: SQL can't train the model; the query is tested against brute force.
SQL = None
