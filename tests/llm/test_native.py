"""License scan, URL filter and exact dedup against brute force."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
import xxhash

from lorelog.llm import common
from lorelog.llm import op1_license_scan as op1
from lorelog.llm import op5_url_filter as op5
from lorelog.llm import op8_exact_dedup as op8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in op1.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places(docs, rows):
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op1.scan_licenses(docs).collect())
    want = sorted((r[0], *brute_base(r[1])) for r in rows)
    assert [tuple(-1 if x is None else x for x in r) for r in got] == [tuple(-1 if x is None else x for x in r) for r in want]


def test_license_labels_of_the_method(spark, no_docs):
    mit = dict((label, text) for label, text in op1.TEMPLATES)["mit"].split()
    changed = [*mit[:10], "really", *mit[10:30], *mit[31:]]  # one word more, one less: three diagonals
    table = spark.createDataFrame(
        [(1, " ".join(["x"] * 5 + changed)), (2, " ".join(mit[:12])), (3, "Under the MIT license and " + " ".join(mit)), (4, " ".join(reversed(mit)))], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in op1.scan_licenses(table).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base) == ("mit", "", 0) and 0.8 <= got[1].score < 1
    assert got[2].labels == "" and abs(got[2].score - 12 / len(mit)) < 1e-9 and (got[4].labels, got[4].score) == ("", 0)
    assert (got[3].labels, got[3].base_labels, got[3].first_word, got[3].score) == ("mit", "mit", 0, 1.0)
    assert op1.scan_licenses(no_docs).count() == 0


def test_exact_groups(docs, rows, no_docs, monkeypatch):
    def norm(t):
        return re.sub("[\x20\x09-\x0d]+", " ", t or "")

    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = sorted((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), r[0] == min(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted(tuple(r)[:5] for r in op8.exact_groups(docs).collect()) == want
    assert {r.text_sha256 for r in op8.exact_groups(docs).filter("not maybe").collect()} <= {w[4] for w in want if w[2] == 1}
    monkeypatch.setattr(common, "PAGE", 8)  # arrays of few bits, which let most rows shuffle, and several ranges change nothing
    monkeypatch.setattr(op8, "RANGE_BITS", 400)
    assert sorted(tuple(r)[:5] for r in op8.exact_groups(docs).collect()) == want
    assert op8.exact_groups(no_docs).count() == 0


@pytest.mark.parametrize("near", [op8.NEAR_ROWS, -1])
def test_duplicates_go_by_id_and_text(spark, docs, rows, no_docs, monkeypatch, near):
    monkeypatch.setattr(op8, "NEAR_ROWS", near)
    found = [(1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "zz"), (5, "q"), (5, "q"), (None, "n"), (None, "n"), (7, None), (8, ""), (9, " \n"), (10, "\t"), (3, "x" * 1_000_000), (2, "x" * 1_000_000)]
    table = spark.createDataFrame([(i, t, "k", "s", k) for k, (i, t) in enumerate(found)], "doc_id long, text string, Sha string, id string, gone int").repartition(3)
    left = op8.drop_duplicates(table)
    want = [(1, "a"), (2, "b"), (None, "zz"), (5, "q"), (None, "n"), (7, None), (9, " \n"), (2, "x" * 1_000_000)]
    assert left.columns == table.columns and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(t)) for i, t in want)
    assert op8.drop_duplicates(no_docs).count() == 0
    texts = {re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows}
    left = op8.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(texts)


def test_exact_filter_sends_few_unique_rows(spark):
    table = spark.range(60_000).selectExpr("id as doc_id", "concat('text ', cast(id % 58000 as string)) as text")
    found = op8.exact_groups(table).cache()
    assert found.filter("maybe and group_size = 1").count() < 0.02 * 56_000 and found.filter("group_size > 1 and not maybe").count() == 0


def brute_url(url, weights):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(s + p, kind) for kind, s, p in op5.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    z = weights[-1]
    for text, share in zip((re.sub("^(www|m)[.]", "", host), "\x01" + path), op5.PART_WEIGHTS):
        grams = []
        marked = "^" + re.sub("[0-9]", "0", text) + "$"
        for n in op5.GRAMS:
            for i in range(len(marked) - n + 1):
                h = xxhash.xxh64_intdigest(marked[i : i + n].encode(), 42)
                grams.append((h - 2**64 if h >= 2**63 else h) % op5.BUCKETS)
        z += share * sum(weights[g] for g in grams) / math.sqrt(max(1, len(grams)))
    score = 1 / (1 + math.exp(-z))
    return host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), score


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x", "https://a.b.example.com/en/8", "x://y://z/q", "ftp://É.net/de/8", "http://sub.example.net/de/81#t", "http://com/en/"]
    urls += ["http://xcom/en/", "http://spam-farm.site.net/fr/1", "http://blog.site.org/es/x\nnew", "http://casino-win.example.org/fr/3", "http://h?q=/en/", "http://news.site.org/about"]
    weights = op5.fit(spark)
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    got = sorted(op5.judge_urls(table, weights).collect())
    for r in got:
        want = brute_url((urls * 2)[r.page_id], weights)
        assert tuple(r)[1:5] == want[:4] and abs(r.score - want[4]) < 1e-9
    assert op5.judge_urls(table.limit(0), weights).count() == 0
    assert [r.verdict for r in got if r.page_id in (11, 13, 15)] == ["block", "block", "allow"]


def blocks(spark, urls, weights):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return [r.score >= 0.5 for r in op5.judge_urls(table, weights).orderBy("page_id").collect()]


def test_url_model_tells_held_out_urls(spark):
    rows = op5.labelled_urls()
    assert len({u for u, _ in rows}) == len(rows) < 200
    right = 0
    for fold in range(op5.FOLDS):
        learn, out = op5.held_out_split(rows, fold)
        assert sorted(learn + out) == sorted(rows)
        weights = op5.fit(spark, learn)
        assert sum(a != bool(b) for a, (_, b) in zip(blocks(spark, [u for u, _ in learn], weights), learn)) <= 2
        right += sum(a == bool(b) for a, (_, b) in zip(blocks(spark, [u for u, _ in out], weights), out))
    assert right >= 0.85 * len(rows)


def test_url_model_on_pages(spark):
    """Spam hosts of ``pages``, none of which the table has, are told from the others."""
    weights = op5.fit(spark)
    urls = sorted({r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect() if r.url})
    spam = [bool(re.search("casino|spam|pills|bets|adult|ads-track", u)) for u in urls]
    got = blocks(spark, urls, weights)
    caught = sum(a and b for a, b in zip(got, spam))
    assert sum(spam) > 50 and caught >= 0.95 * sum(spam) and caught >= 0.9 * sum(got)
    known = ["https://github.com/apache/spark", "https://university.edu/physics", "https://github.com/torvalds/linux", "http://www.math.university.edu/algebra"]
    assert not any(blocks(spark, known, weights))
