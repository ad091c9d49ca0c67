"""The registered queries over whole tables, against brute force or their SQL."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_lines_language_simhash import brute_components, brute_fingerprint
from test_native import LOWER, WORD, brute_base, brute_url

from lorelog.llm import op1_license_scan as op1
from lorelog.llm import op2_best_fit_packing as op2
from lorelog.llm import op5_url_filter as op5
from lorelog.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def rows(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def brute_licenses(text):
    """(labels, score): hits of three words in a row, diagonals within four of each other as one span, covered template words."""
    words = WORD.findall((text or "").translate(LOWER))
    places = {}
    for p in range(len(words) - 2):
        places.setdefault(tuple(words[p : p + 3]), []).append(p)
    labels, score = set(), 0.0
    for label, template in op1.TEMPLATES:
        tokens = template.split()
        diagonals = {}
        for t in range(len(tokens) - 2):
            for p in places.get(tuple(tokens[t : t + 3]), ()):
                diagonals.setdefault(p - t, set()).add(t)
        spans, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > op1.DRIFT:
                spans.append(set())
            spans[-1] |= diagonals[d]
            last = d
        for seen in spans:
            share = len({t + k for t in seen for k in range(3)}) / len(tokens)
            score = max(score, share)
            if share >= op1.COVERAGE:
                labels.add(label)
    base = brute_base(text)[4]
    return ",".join(sorted(labels | set(filter(None, base.split(","))))), 1.0 if base else score


def test_op1(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op1_license_scan")}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {i: brute_base(t) for i, t in texts.items()}
    for i, text in texts.items():
        labels, score = brute_licenses(text)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9, i


def test_op2(spark, texts):
    import public_tokenizers
    from test_tokens import check_packing
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = [], 0
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())) for k, (a, n) in enumerate(op2.cut_pieces(len(ids), 1024))]
    assert check_packing(rows(spark, "op2_best_fit_packing"), want, 1024) <= -(-total // 1024) + 2


def test_op3(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = rows(spark, "op3_simhash_neardup")
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints, 2)


def test_op4(spark, texts):
    """The base by hand; the model's scores beat it on the documents that it has not seen."""
    from test_tokens import brute_counts

    counts, own = brute_counts(list(texts.items()))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows(spark, "op4_lm_scoring")}
    assert set(got) == set(texts)
    for (i, _), tokens in zip(texts.items(), own):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert abs(r.base_score - sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)) < 1e-6 * abs(r.base_score)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.1


def test_op5(spark):
    t = pq.read_table(f"{DATA}/pages.parquet").to_pydict()
    weights = op5.fit(spark)
    want = {i: brute_url(u, weights)[:4] for i, u in zip(t["page_id"], t["url"])}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows(spark, "op5_url_filter")} == want


def test_op7(spark, texts):
    """Every column from the text alone, but for the stored bytes, which are read back by the general reader."""
    from collections import Counter


    from lorelog.llm import op7_media_columns as op7

    used = Counter()
    got = {r.doc_id: r for r in rows(spark, "op7_media_columns")}
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    media = {r.doc_id: bytes(r.media) for r in op7.write_media(table).collect()}
    op7.decode_media(list(media.values()), used)
    assert set(used) >= {"cache", "copy", "predictor", "cross-colour", "subtract-green"}
    for i, text in texts.items():
        raw, r, own = (text or "").encode(), got[i], media[i]
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(own), hashlib.sha256(own).hexdigest())
        pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 4)
        modes = ",".join(str(np.bincount(pixels[:, c]).argmax()) for c in range(4))
        assert r.feature == f"w=144;h={len(payload) // 576};min={min(payload)};max={max(payload)};values={len(set(payload))};modes={modes}"
    for own, text in list(zip(media.values(), (texts[i] for i in media)))[:25]:
        assert b"".join(op7.decode_stream(s).tobytes() for s in op7.streams_of(own)).startswith((text or "").encode())


def test_op9(spark, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op9_sentencepiece"):
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op10(spark, texts):
    """Every prediction by greedy substring search, for the shorter texts; all of them by held-out accuracy."""
    from test_lines_language_simhash import brute_phrases

    from lorelog.llm import op10_language_id as op10

    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"]))
    got = {r.doc_id: r for r in rows(spark, "op10_language_id")}
    told = [r for r in got.values() if r.held_out and lang[r.doc_id]]
    assert len(got) == len(texts) and sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.9 * len(told)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    sample = op10.training_sample(table, "doc_id", "text", "lang", 5, op10.TRAIN_DOCS, op10.TRAIN_CHARS)
    parser = op10.CrossParser(tuple(sample.items()))
    for i, text in sorted(texts.items(), key=lambda x: len(x[1] or ""))[:60]:
        bits = np.array([brute_phrases(text or "", sample[x], parser.classes) for x in parser.langs]) * np.array(parser.weights)
        known = any(c.isalpha() for c in text or "")
        assert got[i].lang_pred == (parser.langs[int(bits.argmin())] if known else "und")
        assert abs(got[i].score - (1 / np.exp2(bits.min() - bits).sum() if known else 0)) < 1e-9
