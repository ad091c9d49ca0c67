"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

A suffix automaton of a bounded sample of labelled text per language gives longest matches.  A text is parsed
against each language into the fewest greedy phrases that occur in its sample; the language with the lowest
phrases * log2(sample length) / symbols wins.

Symbols are lower-cased letters, and one blank for each run of anything else.  The samples' ``ALPHABET`` most frequent
letters have a symbol each, their other letters ``DIGITS`` symbols, as a number in base 16; so any script can be learned.
A letter that no sample has is one symbol that matches nothing.  The parse starts anew every ``CUT`` symbols, in every
language alike, so that a batch of texts is parsed in lockstep by numpy, whole texts at bounded memory.

Bounds: ``train_docs`` rows and ``train_chars`` characters a language are learned from, ``max_langs`` languages (an
automaton takes about 8 MB of a worker; more languages raise an error rather than be left out).
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorelog.llm.common import id_crc

ALPHABET = 46
OTHER = 47
#: The first of the 16 digits, and how many stand for a letter.
DIGIT = 48
DIGITS = 4
WIDTH = 64
CUT = 192
#: A text is foreign where its best parse takes more bits than spelling it, by over so many phrases.
SLACK = 4
SLICE = 1 << 20
TRAIN_DOCS = 200
TRAIN_CHARS = 20_000
MAX_LANGS = 400
#: Characters that one lockstep run takes together.
RUN_CHARS = 4 << 20


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, train_docs: int, train_chars: int, max_langs: int = MAX_LANGS) -> dict[str, str]:
    """Up to train_chars characters of labelled text per language, from the rows outside fold 0 with the least id hashes."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (id_crc() % folds != 0))
    rows = rows.withColumn("text", F.substring("text", 1, train_chars))  # no more of a text shuffles
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000_000)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages are labelled")
    if not counts:
        return {}
    # about four times train_docs rows a language are drawn before the window orders them
    share = [(lang, min(1_000_000_000, 4 * train_docs * 1_000_000_000 // n + 1)) for lang, n in counts.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, below long"))
    drawn = rows.join(limits, "lang").filter("draw < below")
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    least = drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= train_docs)
    before = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("n")) - F.char_length("text")
    least = least.withColumn("before", before).filter(F.col("before") < train_chars)
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    # under 2 * train_chars characters a language
    for r in least.select("lang", "n", "text").orderBy("lang", "n").collect():
        texts[r["lang"]].append(r["text"])
    return {lang: "\n".join(parts)[:train_chars] for lang, parts in sorted(texts.items()) if parts}


def symbols(text: str, classes: np.ndarray) -> np.ndarray:
    out = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(out) > 1:
        out = out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]
    if not len(out) or out.max() < WIDTH:
        return out
    rare = out >= WIDTH
    wide = np.repeat(out, np.where(rare, DIGITS, 1))
    for k in range(DIGITS):
        at = np.cumsum(np.where(rare, DIGITS, 1))[rare] - DIGITS + k
        wide[at] = DIGIT + ((out[rare] - WIDTH) >> 4 * (DIGITS - 1 - k) & 15)
    return wide


def char_classes(sample: dict[str, str]) -> np.ndarray:
    """Class of every code point: 0 for what is no letter, 1..ALPHABET for the samples' usual letters, WIDTH plus a number
    for their other letters, OTHER for letters that no sample has."""
    seen = Counter(c for text in sample.values() for c in text.lower() if c.isalpha())
    out = np.zeros(0x110000, dtype=np.int32)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
    for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
        out[ord(c)] = k + 1 if k < ALPHABET else WIDTH + k - ALPHABET
    return out


def suffix_automaton(seq: list[int]) -> np.ndarray:
    """Transition table (states x WIDTH) of the smallest automaton of all substrings; -1 where there is none."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(to), WIDTH), -1, dtype=np.int32)
    for state, arcs in enumerate(to):
        if arcs:
            table[state, list(arcs)] = list(arcs.values())
    return table


class CrossParser:
    """The automata of all languages; built once a worker from the sample."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        texts = dict(sample)
        self.langs = sorted(texts)
        self.classes = char_classes(texts)
        self.tables, self.weights = [], []
        #: Symbols that the samples use.
        self.kinds = max(2, len(np.unique(np.concatenate([symbols(t, self.classes) for t in texts.values()] or [[]]))))
        for lang in self.langs:
            seq = symbols(texts[lang], self.classes)
            self.tables.append(suffix_automaton([int(c) for c in seq if c != OTHER]))
            self.weights.append(np.log2(max(2, len(seq))))

    def phrases(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each sequence in each language (sequences x languages)."""
        owner, start, length, at = [], [], [], 0
        for i, seq in enumerate(seqs):
            cuts = np.arange(0, len(seq), CUT)
            owner.append(np.full(len(cuts), i))
            start.append(cuts + at)
            length.append(np.minimum(CUT, len(seq) - cuts))
            at += len(seq)
        out = np.zeros((len(seqs), len(self.langs)), dtype=np.int64)
        if not at:
            return out
        owner, start, length = (np.concatenate(x) for x in (owner, start, length))
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        flat = np.concatenate(seqs)
        for k, table in enumerate(self.tables):
            arcs, root = table.ravel(), np.maximum(table[0], 0)
            state, count = np.zeros(len(start), dtype=np.int32), np.zeros(len(start), dtype=np.int32)
            for t, n in enumerate(active):
                c = flat[start[:n] + t]
                then = arcs[state[:n] * WIDTH + c]
                miss = then < 0
                count[:n] += miss
                state[:n] = np.where(miss, root[c], then)
            count += state > 0
            out[:, k] = np.bincount(owner, weights=count, minlength=len(seqs))
        return out

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text in each language, its symbols, and whether it has a letter."""
        run: list[np.ndarray] = []
        where: list[int] = []
        size = 0
        totals = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=bool)

        def flush() -> None:
            nonlocal run, where, size
            if run:
                np.add.at(totals, where, self.phrases(run))
            run, where, size = [], [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text or ""), SLICE):
                seq = symbols(text[at : at + SLICE], self.classes)
                letters[i] |= bool(seq.any())
                n[i] += len(seq)
                run.append(seq)
                where.append(i)
                size += len(seq)
                if size >= RUN_CHARS:
                    flush()
        flush()
        return totals * np.array(self.weights), n, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        bits, _, letters = self.parse(texts)
        for i in np.flatnonzero(letters):
            best = int(np.argmin(bits[i]))  # the first of equals: the smallest name
            out[i] = (self.langs[best], float(1 / np.exp2(np.maximum(-50, bits[i, best] - bits[i])).sum()))
        return out

    def told(self, texts: list[str | None]) -> list[str | None]:
        """The language of each text; None for one without a letter, and for a foreign one.

        Foreign is a text that no sample helps to write: to spell it, each symbol drawn alike from those of the samples,
        takes fewer bits than its best parse, by more than SLACK phrases.
        """
        if not self.langs:
            return [None] * len(texts)
        bits, n, letters = self.parse(texts)
        best = bits.argmin(axis=1)
        spelled = n * np.log2(self.kinds) + SLACK * np.array(self.weights)[best]
        good = letters & (bits[np.arange(len(texts)), best] <= spelled)
        return [self.langs[k] if ok else None for k, ok in zip(best.tolist(), good.tolist())]


@functools.lru_cache(maxsize=2)
def _parser(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(sample)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the winner's share of 2^-bits).

    Learns from the rows with a language whose crc32(id) mod folds isn't 0.  A text that is null or has no letter
    is ``und`` with score 0, and so is every text where nothing was labelled.  Equal texts get equal results; of
    languages with equal costs the smallest name wins.  Other columns are ignored; an empty table gives no rows.
    """
    sample = tuple(training_sample(docs, id_col, text_col, lang_col, folds, train_docs, train_chars).items())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc(id_col) % folds == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sample)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = parser.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(
    docs: DataFrame,
    languages: tuple[str, ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    train_docs: int = TRAIN_DOCS,
    train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """The documents, with all their columns, that are written in one of the languages (None: any that was learned).

    The language is that of the cheapest parse, whatever the row's label.  Texts without a letter go, and so do foreign
    texts, whose best parse is no cheaper than spelling.  A row without a label gets the language found; others keep
    theirs.  Each row is judged where it is read; nothing shuffles.  Where nothing was labelled, no row can be told and
    all go; an empty table gives no rows.  Other columns pass through, whatever their names.
    """
    sample = tuple(training_sample(docs, id_col, text_col, lang_col, folds, train_docs, train_chars).items())
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sample)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                told = parser.told(part.column(text_at).to_pylist())
                good = [lang is not None and (languages is None or lang in languages) for lang in told]
                lang = part.column(lang_at)
                filled = pc.coalesce(lang, pa.array(told, pa.string()).cast(lang.type))
                yield part.set_column(lang_at, part.schema.field(lang_at), filled).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: SQL can't express the parse; the query is tested against brute force and for held-out accuracy.
SQL = None
