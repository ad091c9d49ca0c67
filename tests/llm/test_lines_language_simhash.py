"""Line dedup, language ID and SimHash against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorelog.llm import op3_simhash_neardup as op3
from lorelog.llm import op6_line_dedup as op6
from lorelog.llm import op10_language_id as op10
from lorelog.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        rest = [x for x in lines if not (len(holders[key(x)]) >= 5 and max(holders[key(x)]) != r[0])]
        out.append((r[0], len(lines), len(lines) - len(rest), hashlib.sha256("\n".join(rest).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(docs, rows, batches, fanout):
    found = op6.dedup_lines(docs, batches=batches, fanout=fanout)
    got = found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)
    assert found.columns[: len(docs.columns)] == docs.columns


def test_lines_of_nothing(spark, no_docs):
    assert op6.dedup_lines(no_docs).count() == 0
    table = spark.createDataFrame([(None, "a" * 50), (None, "a" * 50), (1, "A" * 50 + " "), (2, "a" * 50), (3, "a" * 50 + "\nb")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in op6.dedup_lines(table).collect())
    assert got == [(0, ""), (0, ""), (1, ""), (2, ""), (3, "a" * 50 + "\nb")]


def test_line_columns_of_any_name(spark):
    names = ["__drop", "text_", "id_", "Digest_", "slot_", "hit_", "lines_", "n_lines", "N_dropped", "places", "id", "digest"]
    table = spark.createDataFrame([(k, f"{'a' * 50}\nown {k}", *names) for k in range(6)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = op6.dedup_lines(table)
    assert found.columns == [*table.columns, "n_lines_", "n_dropped_"]
    want = sorted((k, f"own {k}" if k < 5 else "a" * 50 + "\nown 5", *names, 2, int(k < 5)) for k in range(6))
    assert sorted(map(tuple, found.collect())) == want


def test_many_lines_and_long_lines(spark):
    line = lambda k: f"line number {k} of those that all the documents share"
    shared = [line(k) for k in range(20_000)]
    texts = ["\n".join(shared[k:] + shared[:k] + shared[:3]) for k in range(5)] + ["\n" * 1_000_000, "z" * 1_000_000, None, "\n".join([line(0)] * 3000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = op6.dedup_lines(table).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == brute_lines(list(enumerate(texts)))


def test_rows_that_share_an_id(spark):
    a, b = "a" * 50, "b" * 50
    rows = [(1, f"{a}\n1"), (1, f"2\n{a}"), (1, f"{a}\n1"), (2, a), (3, a), (None, f"x\n{a}"), (None, f"{a}\ny"), (3, f"{b}\n{a}")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in op6.dedup_lines(table).collect())
    assert got == sorted([("1", "1"), ("1", "2"), ("1", "1"), ("2", ""), ("3", a), ("None", "x"), ("None", "y"), ("3", f"{b}\n{a}")])


def test_runs_are_merged_where_they_lie(spark):
    """Neither a run's join with a batch nor the merge of two runs deals or sorts the runs again."""
    runs = op6.LineRuns(spark, fanout=3)
    lines = spark.range(1000).selectExpr("id", "unhex(md5(cast(id % 300 as string))) as hash")
    runs.add(lines)
    runs.add(lines)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    with op6._sorted_buckets(spark):
        merge, join = plan(runs.merge(runs.runs())), plan(runs.anti_joined(lines))
    assert all(len([f for f in run.inputFiles()]) <= 4 for run in runs.runs())  # a bucket is one file
    assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and "Sort [" not in merge
    assert join.count("SortMergeJoin") == 2 and join.count("Exchange") == 1 and join.count("Sort [") == 1  # those of the batch
    runs.close()
    assert not runs.runs() and not [t for t in spark.catalog.listTables() if t.name.startswith("lorelog_run")]


def test_lines_sql(docs, unique, spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in unique], columns=["doc_id", "text"]))
    assert sorted(con.sql(op6.SQL).fetchall()) == brute_lines(unique)


def brute_phrases(text, sample, classes):
    """Greedy longest matches by substring search, anew every CUT symbols."""
    seq = "".join(map(chr, op10.symbols(text, classes)))
    body = "".join(chr(c) for c in op10.symbols(sample, classes) if c != op10.OTHER)
    count = 0
    for at in range(0, len(seq), op10.CUT):
        phrase = ""
        for c in seq[at : at + op10.CUT]:
            if phrase + c in body:
                phrase += c
            else:
                count += 1
                phrase = c if c in body else ""
        count += bool(phrase)
    return count


def test_cross_parsing(rows):
    sample = {"de": rows[1][1] + " der die das nicht überall", "en": "the of and is under walking house river"}
    parser = op10.CrossParser(tuple(sample.items()))
    texts = [r[1][:1500] for r in rows if r[1]]
    got = parser.phrases([op10.symbols(t, parser.classes) for t in texts])
    want = [[brute_phrases(t, sample[lang], parser.classes) for lang in parser.langs] for t in texts]
    assert got.tolist() == want


def test_languages(docs, rows, no_docs):
    got = op10.identify_languages(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for r in rows:
        x = by_id[r[0]]
        assert x.held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in r[1] or ""))
        assert 0 <= x.score <= 1
    told = [(by_id[r[0]].lang_pred, r[2]) for r in rows if r[2] and by_id[r[0]].held_out and r[1] and len(r[1]) > 100]
    assert sum(a == b for a, b in told) >= 0.9 * len(told)
    assert op10.identify_languages(no_docs).count() == 0
    unlabelled = op10.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_languages_that_stay(spark, docs, rows, no_docs):
    def spelling(lang):
        return op10.keep_languages(docs, lang)

    pred = {r.doc_id: r.lang_pred for r in op10.identify_languages(docs).collect()}
    kept = spelling(None)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    foreign = {i for i in pred if pred[i] != "und"} - set(got)
    assert 3004 in foreign and len(foreign) <= 3  # Japanese among English and German
    assert all(got[r[0]] == (r[2] or pred[r[0]]) for r in rows if r[0] in got)
    assert {r.doc_id for r in spelling(("de",)).collect()} == {i for i in got if pred[i] == "de"}
    assert op10.keep_languages(no_docs).count() == 0
    assert op10.keep_languages(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    odd = [(1, "qqq zzz xxx " * 60, None), (2, "日本語のテキスト" * 20, None), (3, None, "en"), (4, "", "de"), (5, "12 !", "en"), (6, " ".join(r[1] for r in rows[:40] if r[2] == "de"), None), (None, rows[0][1] + " house river of the " * 30, "xx")]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i and 10_000 + i, t, g) for i, t, g in odd], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang for r in op10.keep_languages(more).collect() if r.doc_id is None or r.doc_id > 10_000}
    assert got == {10_006: "de", None: "xx"}


def test_letters_of_many_scripts():
    rng = np.random.default_rng(7)
    write = lambda first, n: "".join(chr(first + int(k)) + ("" if rng.random() < 0.7 else " ") for k in rng.integers(0, 300, n) ** 2 // 300)
    starts = {"a": 0x4E00, "b": 0x4E60, "c": 0xAC00, "d": 0x61}
    sample = {lang: write(at, 6000) if lang != "d" else "plain words of a language " * 200 for lang, at in starts.items()}
    parser = op10.CrossParser(tuple(sample.items()))
    assert max(len(op10.symbols(t, parser.classes)) for t in sample.values()) > 6000
    seq = op10.symbols("a" + sample["a"][:1] + "\u0416 a", parser.classes)
    assert seq.max() < op10.WIDTH and list(seq).count(op10.OTHER) == 1 and (seq >= op10.DIGIT).sum() in (0, op10.DIGITS)
    told = [parser.predict([write(starts[lang], 400)])[0][0] for lang in "abc"]
    assert told == ["a", "b", "c"]


def test_long_texts_have_a_language():
    text = {"en": "the house of the river and the road " * 300, "de": "das Haus an dem Fluss und der Weg " * 300}
    parser = op10.CrossParser(tuple(text.items()))
    long = text["de"] * 120
    assert len(long) > 1_000_000 and [x[0] for x in parser.predict([long, "und " * 300_000, None, ""])] == ["de", "de", "und", "und"]


def brute_fingerprint(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b, c in ones.items() if 2 * c > len(grams))


def brute_components(prints, radius):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("radius", "tile"), [(2, 4096), (4, 3)])
def test_simhash(docs, rows, radius, tile):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    got = op3.near_components(docs, radius=radius, tile=tile).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: int.from_bytes(r.fp, "little") for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints, radius)


def test_simhash_of_long_and_odd_texts(spark, no_docs, monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    whole = op3.fingerprint(text.encode())
    monkeypatch.setattr(op3, "SLICE", 17)
    assert op3.fingerprint(text.encode()) == whole == brute_fingerprint(text).to_bytes(8, "little")
    assert op3.near_components(no_docs).count() == 0
    table = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (4, "A  b c"), (7, None), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in op3.near_components(table).collect()}
    assert got == {(None, None), (5, 4), (4, 4), (7, 6), (6, 6)}


def test_any_number_of_segments_gives_the_same_links(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (6, 2))})
    classes = spark.createDataFrame([(x.to_bytes(8, "little"), i) for i, x in enumerate(fps)], "fp binary, node long")
    want = brute_components(dict(enumerate(fps)), 2)
    for segments in (1, 4, 8, 16):
        got = {r.node: r.component for r in components(op3.links(classes, 1, 2, segments, 16, 2)).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert [op3.segments_for(n) for n in (0, 10**6, 10**7, 10**9)] == [4, 4, 8, 16]


def test_one_row_of_each_group_stays(spark, no_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "t u"), (1, "t u"), (2, "T  u"), (None, "t u"), (None, "t u"), (5, text), (6, text + " more"), (6, "other words here"), (7, "other words here"), (8, None), (9, ""), (10, " "), (11, "x " * 200_000), (12, "x " * 300_000)]
    table = spark.createDataFrame([(i, t, "a", "b", "c", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, GONE_ID string, digest string, least int").repartition(3)
    left = op3.one_of_each(table)
    assert left.columns == table.columns
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in left.collect()) == sorted([("1", "t u"), ("None", "t u"), ("None", "t u"), ("5", text[:9]), ("8", ""), ("11", "x x x x x")])
    assert op3.one_of_each(no_docs).count() == 0


def test_wide_prints_find_near_copies(spark):
    rng = np.random.default_rng(0)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(20)]
    table = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(5):  # one word of 200 changed: similarity about 0.95
        table.append((100 + i, " ".join([*texts[i][:50], "other", *texts[i][51:]])))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert {r.doc_id for r in op3.one_of_each(docs, tile=7).collect()} == set(range(20))


@pytest.mark.parametrize("block", [3, 256])
def test_near_copies_are_decided_by_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(op3, "BLOCK_ROWS", block)
    table, kept = [], set()
    for n, (size, less) in enumerate([(5, 1), (10, 2), (100, 20), (190, 38)] * 10):
        words = [f"t{n}w{i}" for i in range(size + 4)]  # so many shingles
        table += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[: len(words) - less]))]  # 0.8
        other = [f"s{n}w{i}" for i in range(size + 4)]
        table += [(10 * n + 2, " ".join(other)), (10 * n + 3, " ".join(other[: len(other) - less - 1]))]  # just below
        kept |= {10 * n, 10 * n + 2, 10 * n + 3}
    group = [f"g{i}" for i in range(104)]
    table += [(1000 + i, " ".join([*group, *(f"h{i}x{j}" for j in range(5))])) for i in range(20)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert {r.doc_id for r in op3.one_of_each(docs, tile=64).collect()} == kept | {1000}


def test_repeats_of_a_passage_do_not_count_in_near_copies(spark):
    passage = [f"p{i}" for i in range(24)]
    own = [[f"{c}{i}" for i in range(304)] for c in "abc"]
    table = [(1, own[0] + passage * 20), (2, own[1] + passage * 20), (3, own[2] + passage * 2), (4, own[2] + passage * 10)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in table], "doc_id long, text string")
    assert {r.doc_id for r in op3.one_of_each(docs).collect()} == {1, 2, 3}


def test_tile_links_join_all_with_few_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = (base[rng.integers(0, 4, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))).reshape(-1, 1)
    found = list(op3.tile_links(fps, None, 2, 2))
    assert len(found) == 296 and all(bin(int(fps[a, 0] ^ fps[b, 0])).count("1") <= 2 for a, b in found)


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (102, 100), (100, 102), (50, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 40: 40, 50: 40}
