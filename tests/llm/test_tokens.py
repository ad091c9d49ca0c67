"""Packing, LM scoring and SentencePiece against brute force and the public libraries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorelog.llm import op2_best_fit_packing as op2
from lorelog.llm import op4_lm_scoring as op4
from lorelog.llm import op9_sentencepiece as op9

ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x\t y ", "it's we'll 12 3a", "a b   c", "x\x1c y \x85z", "日本 語 😀 é́", "tail  ", "don't  'quoted' 'll", "　a  b", "a\r\nb c", "==== ----- ....", " " * 40 + "q", "a" * 300]


# --- packing ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_librarys(library, rows, monkeypatch):
    coder = op2.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "<|endoftext|> as text", *(r[1] for r in rows if r[1])]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(coder.encode(t), dtype=np.uint32).tolist() for t in texts] == want
    monkeypatch.setattr(op2, "SLICE", 7)
    assert [np.frombuffer(coder.encode(t), dtype=np.uint32).tolist() for t in texts] == want


LONG = {
    "blanks": " " * 1_000_000, "lines": "\n" * 1_000_000, "between": "a" + " " * 1_000_000 + "b", "mixed": "x\n" + " \t\n\u3000" * 250_000 + "\u2003y z",
    "letters": "a" * 1_000_000, "no spaces": "日本語テキスト" * 50_000, "words": "some words " * 100_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_runs_have_the_librarys_ids(library, name):
    coder = op2.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(coder.encode(LONG[name]), dtype=np.uint32).tolist() == library.encode(LONG[name], add_special_tokens=False).ids
    assert max([0, *map(len, [*coder.first, *coder.rest, *coder.blanks])]) <= op2.LONG_WORD


def test_runs_of_blanks_have_the_librarys_ids(library, monkeypatch):
    coder = op2.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(op2, "SLICE", 11)
    coder.rest.limit = coder.first.limit = 5
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("aZ9.'s\u3042\t\n\r \x0b\x1c\x85\xa0\u2003\u3000\u200b    ") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(coder.encode(text), dtype=np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_packed(spark):
    table = spark.createDataFrame([(1, LONG["blanks"]), (2, LONG["between"]), (3, None)], "doc_id long, text string")
    found = op2.pack(table).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in found} == {1: 1_000_001, 2: 1_000_002, 3: 1}


def check_packing(found, want_pieces, capacity):
    assert sorted(tuple(r)[:5] for r in found) == sorted(want_pieces)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(docs, rows, library, no_docs):
    want = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for k, (at, n) in enumerate(op2.cut_pieces(len(ids), 1024)):
            want.append((r[0], k, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())))
    found = op2.pack(docs, with_ids=True).collect()
    n = check_packing(found, want, 1024)
    assert n <= -(-sum(w[3] for w in want) // 1024) + 2
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in found)
    assert op2.pack(no_docs).count() == 0


def test_cut_pieces():
    assert op2.cut_pieces(1024, 1024) == [(0, 1024)]
    assert op2.cut_pieces(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert op2.cut_pieces(1, 1024) == [(0, 1)]


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_sound_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 1024])
    lengths = [rng.randint(1, capacity) if seed % 2 else max(1, int(capacity * rng.betavariate(2, 3))) for _ in range(3000)]
    histogram = dict(Counter(lengths))
    for bound in op2.LARGE:
        plan = op2._plan(histogram, capacity, 16, capacity / bound)
        used, ranks = defaultdict(list), defaultdict(set)
        for length, rank, count, first, offset in plan.rows:
            for i in range(count):
                used[first + i].append((offset, length))
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
        assert {k: len(v) for k, v in ranks.items()} == histogram and all(max(v) == len(v) - 1 for v in ranks.values())
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == plan.sequences
    best = op2.make_plan(histogram, capacity, 16).sequences
    halves = sum(c for n, c in histogram.items() if n > capacity / 2)
    assert best <= 1.03 * max(halves, sum(lengths) / capacity) + 2


def test_configurations_reach_the_bound():
    # 50 bins of (7, 3) and 50 of (4, 4, 2) are perfect
    found = op2.configurations([7, 4, 3, 2], [50, 100, 50, 50], 10)
    assert sum(n for n, _ in found) == 100


def test_hot_length_is_ranked_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op2, "BUCKET_ROWS", 50)
    pieces = spark.range(2000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 7, id % 50) as long) as length", "id as ids_crc32")
    got = defaultdict(list)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    for r in op2.ranked(pieces, histogram).collect():
        got[r.length].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


# --- LM scoring ---


def brute_counts(rows):
    counts, own = Counter(), []
    for r in rows:
        own.append([*(r[1] or "").encode().lower().split(), b"\n"])
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10:
            counts.update(own[-1])
    return counts, own


def test_words_and_their_numbers():
    import pyarrow as pa

    texts = ["", " ", "A b\tB \x0b\x0cé É  ", "\n x", "no blanks", "a\x1cb a\u00a0b", "  A " * 3]
    words, sizes = op4.words_of(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for own in want for w in own] and sizes.tolist() == list(map(len, want))
    lexicon = op4.Lexicon([b"\n", b"a", b"b"], [5, 3, 2], [0] * op4.SUFFIXES, [0] * op4.SUFFIXES)
    numbers, rest = lexicon.numbers(pa.array(texts))
    number = lambda w: lexicon.words.index(w) if w in lexicon.words else 3 + int.from_bytes(w[-3:], "big") % op4.SUFFIXES
    assert [np.frombuffer(x, dtype=np.uint16).tolist() for x in numbers.to_pylist()] == [[*map(number, own), 0] for own in want]
    assert rest.to_pylist() == [b"\n".join(w for w in own if w not in lexicon.words) or None for own in want]


def test_base_scores(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(op4, "CUT_BYTES", 900)
    monkeypatch.setattr(op4, "RUN", 70)
    counts, own = brute_counts(rows)
    tokens = dict(zip((r[0] for r in rows), own))
    n, v = sum(counts.values()), len(counts)
    got = op4.score_documents(docs, vocab=20, block_bytes=4000).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        want = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(own), sum(counts[t] > 0 for t in own), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
    assert op4.score_documents(no_docs).count() == 0


def test_nothing_to_learn_and_odd_rows(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    table = spark.createDataFrame([(out[0], "a b a"), (out[1], None), (out[2], ""), (out[3], "w " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in op4.score_documents(table).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {out[0]: (4, 0, 0), out[1]: (1, 0, 0), out[2]: (1, 0, 0), out[3]: (300_001, 0, 0)}
    assert all(np.isfinite([r.score, r.base_score]).all() for r in got.values())
    rows = [(None, "x y z"), (1, "x y"), (1, "x y"), (1, "other words"), (2, "x\x0by z " * 50)]
    table = spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], "doc_id long, text string, block string, part string, digest string, ids string, rest string, word string, raw string")
    got = op4.score_documents(table).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"] and len({r.score for r in got if r.doc_id == 1}) == 2


def prose(n, seed=1):
    """Texts in two made-up languages that share no words but a few."""
    rng = np.random.default_rng(seed)
    words = [[f"{a}{x}{k % 7}" for k, x in enumerate(rng.integers(0, 10**6, 400).tolist())] + ["of", "to"] for a in "xy"]
    share = 1 / np.arange(1, 403)
    return [(i, " ".join(words[i % 2][k] for k in rng.choice(402, 150, p=share / share.sum()))) for i in range(n)]


def test_scores_beat_the_base_and_layouts_agree(spark):
    table = spark.createDataFrame(prose(600), "doc_id long, text string")
    two = {r.doc_id: r for r in op4.score_documents(table.repartition(2), block_bytes=300_000).collect()}
    nine = {r.doc_id: r for r in op4.score_documents(table.orderBy("text").repartition(9), block_bytes=300_000).collect()}
    assert all(abs(two[i].score - nine[i].score) < 1e-6 * abs(two[i].score) for i in two)
    held = [r for r in two.values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.15  # the language alone is worth 0.3 a token


def small_model(n=40, words=33, seed=3):
    rng = np.random.default_rng(seed)
    shares = rng.random(n) ** 3 + 1e-3
    model = op4.Model(shares / shares.sum(), 0)
    for name in "rq":
        model.parts[name][...] += rng.normal(0, 1, model.parts[name].shape)
    return model, op4.Scorer(model, words)


def test_probabilities_sum_to_one():
    model, scorer = small_model()
    rng = np.random.default_rng(0)
    for _ in range(5):
        before = np.repeat(rng.integers(0, 40, (op4.CONTEXT, 1)), 40, axis=1).astype(np.uint16)
        lp = scorer.log10(before, np.arange(40, dtype=np.uint16))
        assert abs((10**lp).sum() - 1) < 1e-5 and (lp < 0).all()


def test_tree_probabilities_by_hand(monkeypatch):
    monkeypatch.setattr(op4, "BRANCH_SPLITS", 1)
    monkeypatch.setattr(op4, "LEAF_SPLITS", 2)
    model, scorer = small_model()
    q = model.parts["q"].astype(float)
    before = np.random.default_rng(1).integers(0, 40, (op4.CONTEXT, 40)).astype(np.uint16)
    guess = model.guesses(before).astype(float)
    got = scorer.log10(before, np.arange(40, dtype=np.uint16))
    weight = lambda rows, g: math.exp(g @ op4._pooled(q[rows]))
    for w in range(40):
        g = guess[w]
        tops = [np.flatnonzero(scorer.branch == k) for k in range(len(scorer.leaves))]
        leaves = [[np.flatnonzero((scorer.branch[:33] == k) & (scorer.leaf[:33] == j)) for j in sorted(set(scorer.leaf[t].tolist()))] for k, t in enumerate(tops)]
        pool = lambda rows_of: op4._pooled(np.array([op4._pooled(q[x]) for x in rows_of]))
        ways = [math.exp(g @ pool(x)) for x in leaves] + [math.exp(g @ q[k]) for k in range(33, 40)]
        if w >= 33:
            want = ways[len(tops) + w - 33] / sum(ways)
        else:
            k = int(scorer.branch[w])
            leaf = next(x for x in leaves[k] if w in x)
            want = ways[k] / sum(ways) * weight(leaf, g) / sum(weight(x, g) for x in leaves[k])
            want *= math.exp(g @ q[w]) / sum(math.exp(g @ q[x]) for x in leaf)
        assert abs(got[w] - math.log10(want)) < 1e-4


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(3)
    text = []
    for _ in range(4000):  # 1 is followed by 2, 2 by 3
        text += [1, 2, 3] if rng.random() < 0.7 else [int(rng.integers(1, 5))]
    w = np.array(text, dtype=np.uint16)
    shares = np.bincount(w, minlength=70) + 0.1
    model = op4.Model(shares / shares.sum(), 0)
    trainer = op4.Trainer(model)
    for _ in range(3):
        trainer.fit(w, np.array([len(w)]))
    before = op4.contexts(w, np.array([len(w)]), 0)
    gain = op4.Scorer(trainer.model, 6).log10(before, w).mean() - np.log10(model.shares[w]).mean()
    assert gain > 0.15


def test_contexts():
    before = op4.contexts(np.array([5, 6, 7, 8, 9, 10]), np.array([3, 1, 2]), 0)
    assert before[:3].tolist() == [[0, 5, 6, 0, 0, 9], [0, 0, 5, 0, 0, 0], [0, 0, 0, 0, 0, 0]]


def test_sums_of_parameters_are_whole_numbers():
    import pyarrow as pa

    rows = [(k % 2, 1, np.array([k * 10**9, -k]) if k else np.array([5, 5])) for k in range(7)]
    batches = [pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "n": [n], "sums": pa.array([op4._packed(x)], pa.binary())}) for k, n, x in rows]
    (got,) = op4._added(iter(batches), [2, 2])
    read = [np.frombuffer(x, dtype=np.int32 if len(x) == 8 else np.int64).tolist() for x in got.column(2).to_pylist()]
    assert dict(zip(got.column(0).to_pylist(), read)) == {0: [5 + 12 * 10**9, 5 - 12], 1: [9 * 10**9, -9]} and got.column(1).to_pylist() == [4, 3]


# --- SentencePiece ---


@pytest.fixture(scope="module")
def piece_path():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_paths_are_the_librarys(piece_path, rows):
    machine = op9.Transducer(piece_path)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdeflnorst  .,'▁\n12é日") for _ in range(60)) for _ in range(300)]
    for text in [*ODD, "▁x▁▁y", "<s> hi <0x0A>", *noise, *(r[1] for r in rows if r[1])]:
        want = library.encode(text)
        ids = machine.encode(text)
        assert np.frombuffer(ids, dtype=np.uint32).tolist() == want, text[:60]
        assert machine.decode(ids) == library.decode(want)


def own_model(kind, rule="identity", strip=False, fallback=True, user=(), prefix=True):
    """A small model made by hand, as bytes: pieces of the public model with its scores, under another specification."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    given = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        given.ParseFromString(f.read())
    model = pb.ModelProto()
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = fallback
    for i, p in enumerate(given.pieces):
        if (p.type == op9.BYTE and not fallback) or (p.type == op9.NORMAL and set(p.piece) == {"▁"} and len(p.piece) > 1):
            continue
        score = p.score if kind == op9.BPE or p.type != op9.NORMAL else -float(np.float32(4 + (i * 7919 % 1000) / 97 - 1.5 * (len(p.piece) - 1)))
        model.pieces.add(piece=p.piece, score=score, type=p.type)
    for piece in user:
        model.pieces.add(piece=piece, score=0, type=op9.USER)
    maps = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto()
    spec.ParseFromString(maps.serialized_model_proto())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces = strip
    model.normalizer_spec.add_dummy_prefix = prefix
    model.normalizer_spec.escape_whitespaces = True
    return model.SerializeToString()


@pytest.mark.parametrize("kind", [op9.UNIGRAM, op9.BPE])
@pytest.mark.parametrize(
    "spec", [{}, {"rule": "nmt_nfkc", "strip": True}, {"rule": "nfkc_cf", "fallback": False}, {"user": ("<tag>", "▁New▁York", "ﬁne"), "rule": "nfkc"}, {"prefix": False, "strip": True}]
)
def test_other_models_are_compiled_like_the_librarys(kind, spec, rows):
    proto = own_model(kind, **spec)
    machine, library = op9.Transducer(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(4)
    texts = ["", " ", "  a  b ", "ﬁne ｆｕｌｌ ①② e\u0301 é Å\u030a", "tab\tnew\nline\u200b\u3000x", "カ\u3099ﾊﾟ㌔", "<tag>a<tag> New York, in New York", "日本語日本語 😀😀 ░░"]
    texts += ["".join(rng.choice("abcdeflnorst  .,éＡﬁ½e\u0301日<tag>") for _ in range(80)) for _ in range(150)]
    texts += [r[1][:3000] for r in rows if r[1]]
    got = [np.frombuffer(x, dtype=np.uint32).tolist() for x in machine.encode_all(texts)]
    for text, ids in zip(texts, got):
        want = library.encode(text)
        if kind == op9.UNIGRAM and ids != want:  # equal sums in another order of single-precision additions
            weight = lambda path: sum(library.get_score(i) for i in path)
            assert abs(weight(ids) - weight(want)) < 1e-3, text[:60]
        else:
            assert ids == want, text[:60]


def test_parts_relaxed_together_are_those_relaxed_alone(piece_path, monkeypatch):
    rng = random.Random(9)
    parts = sorted({"".join(rng.choice("▁▁aeinorstlé日x,.") for _ in range(rng.randint(1, 30))) for _ in range(3000)})
    for kind in (op9.BPE, op9.UNIGRAM):
        machine = op9.Transducer(proto=own_model(kind))
        assert machine.relax(parts) == [machine._emit(machine.shortest_path(p)) for p in parts]
    machine = op9.Transducer(piece_path)
    assert machine.relax(parts) == [machine._emit(machine.shortest_path(p)) for p in parts]


def test_bounds_change_no_ids(piece_path, monkeypatch):
    texts = ["a house, two houses and 日本 " * 40, "x" * 3000, "b" * 70 + " c", "", "▁ ▁▁", "\n\nword"] * 3
    want = [sentencepiece.SentencePieceProcessor(model_file=piece_path).encode(t) for t in texts]
    for name, value in (("CACHE_PARTS", 3), ("RUN_CHARS", 50), ("RUN_PARTS", 4)):
        monkeypatch.setattr(op9, name, value)
    assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in op9.Transducer(piece_path).encode_all(texts)] == want


def test_very_long_texts(piece_path):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    machine = op9.Transducer(piece_path)
    for text in ("z" * 200_000, "word, " * 400_000, " " * 100_000 + "x", "日本語" * 30_000):
        ids = machine.encode(text)
        want = library.encode(text)
        assert np.frombuffer(ids, dtype=np.uint32).tolist() == want and machine.decode(ids) == library.decode(want)


def test_piece_operator(docs, rows, no_docs, piece_path):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    encoded = op9.encode_texts(docs)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in op9.token_digest(encoded).collect()}
    want = [library.encode(r[1] or "") for r in rows]
    assert got == {(r[0], len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for r, w in zip(rows, want)}
    assert {(r.doc_id, r.text) for r in op9.decode_ids(encoded).collect()} == {(r[0], library.decode(w)) for r, w in zip(rows, want)}
    assert op9.token_digest(op9.encode_texts(no_docs)).count() == 0
