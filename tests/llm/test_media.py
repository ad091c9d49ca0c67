"""The image codec by exact round trips, and the operator against plain digests."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from lorelog.llm import op7_media_columns as op7
from lorelog.llm import webp_batch


def image(rng, height, width, colours):
    return rng.integers(0, 256, (colours, 4))[rng.integers(0, colours, (height, width))].astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1, 1), (5, 7, 2), (9, 13, 4), (6, 17, 16), (12, 11, 200), (20, 21, 1000)])
@pytest.mark.parametrize("coding", [("level", 0, False, 0), ("huffman", 0, False, 0), ("huffman", 3, True, 0), ("huffman", 11, False, 0), ("huffman", 5, True, 2)])
def test_round_trip(size, coding):
    x = image(np.random.default_rng(1), *size)
    for transforms in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)):
        if 3 in transforms and size[2] > 256:
            continue
        how, cache, copies, groups = coding
        assert (op7.decode_stream(op7.encode_stream(x, how, transforms, cache, copies, groups, mode=14)) == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = image(np.random.default_rng(mode), 9, 10, 90)
    assert (op7.decode_stream(op7.encode_stream(x, "huffman", (op7.PREDICTOR,), mode=mode)) == x).all()


def test_near_places_are_all_different():
    assert len(set(op7.NEAR_PLACES)) == 120 and all(0 <= y < 8 and -8 < x <= 8 and (y or x > 0) for x, y in op7.NEAR_PLACES)


def test_a_published_file():
    """The one-pixel lossless file that browsers are probed with; it has a colour cache, simple codes and one transform less pixel."""
    media = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    (image,) = op7.decode_media([media])[0]
    (stream,) = op7.streams_of(media)
    assert image.shape == (1, 1, 4) and (image == op7.decode_stream(stream)).all()


def argb(x):
    return webp_batch._packed(x[..., [3, 0, 1, 2]])


def samples():
    rng = np.random.default_rng(5)
    out = [image(rng, int(rng.integers(1, 17)), 144, int(c)) for c in (1, 2, 3, 10, 17, 200, 257, 5000) for _ in range(12)]
    for x in out[::3]:
        x[len(x) // 2 :] = x[: len(x) - len(x) // 2]
    return out


def test_both_readers_read_the_batch_writer():
    images, used = samples(), Counter()
    streams = webp_batch.encode_streams([argb(x) for x in images])
    assert streams == [webp_batch.encode_streams([argb(x)])[0] for x in images]  # whatever stands beside an image
    for x, stream, got in zip(images, streams, webp_batch.decode_streams(streams, used)):
        assert (op7.decode_stream(stream) == x).all() and (got == x).all()
    assert set(used) == {"cache", "copy", "predictor", "cross-colour", "subtract-green", "palette"}


@pytest.mark.parametrize("coding", [("level", 0, False, 0), ("huffman", 0, False, 0), ("huffman", 3, True, 0), ("huffman", 11, False, 0), ("huffman", 5, True, 2)])
def test_the_batch_reader_reads_the_general_writer(coding):
    how, cache, copies, groups = coding
    images, streams = [], []
    for k, size in enumerate([(1, 1, 1), (5, 7, 2), (9, 13, 4), (6, 17, 16), (12, 11, 200), (20, 21, 1000), (40, 9, 3)]):
        for transforms in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)):
            if 3 in transforms and size[2] > 256:
                continue
            images.append(image(np.random.default_rng(k), *size))
            streams.append(op7.encode_stream(images[-1], how, transforms, cache, copies, groups, mode=14))
    found = webp_batch.decode_streams(streams)
    assert all((got is None and groups) or (got == x).all() for x, got in zip(images, found))
    media = [op7.container(s) for s in streams]
    assert all((got[0] == x).all() for x, got in zip(images, op7.decode_media(media)))


def test_prefix_codes_are_complete_and_near_the_entropy():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, (300, 344)) * (rng.random((300, 344)) < rng.random((300, 1))) ** 2 * rng.integers(1, 200, (300, 344))
    counts[0], counts[1] = 0, 0
    counts[1, 7] = 9
    for limit in (10, 9):
        lengths, words = webp_batch.prefix_codes(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
        for row, size, code in zip(counts, lengths, words):
            if (row > 0).sum() > 1:
                assert (0.5 ** size[size > 0]).sum() == 1
                share = row[row > 0] / row.sum()
                assert (share * size[size > 0]).sum() < -(share * np.log2(share)).sum() + 1.2
                texts = [f"{c:0{n}b}"[::-1][:n] for c, n in zip(code[size > 0].tolist(), size[size > 0].tolist())]
                assert len(set(texts)) == len(texts) and not any(b.startswith(a) for a, b in zip(sorted(texts), sorted(texts)[1:]))


def test_broken_streams_are_refused():
    good = op7.encode_stream(image(np.random.default_rng(2), 9, 9, 50), "level")
    with pytest.raises(ValueError):
        op7.decode_stream(good[:60])
    with pytest.raises(ValueError):
        op7.decode_stream(b"\0" + good[1:])
    with pytest.raises(ValueError):
        list(op7.streams_of(b"RIFX" + bytes(20)))
    for bad in (good[:60], b"\0" + good[1:], webp_batch.encode_streams([argb(samples()[-1])])[0][:300]):
        with pytest.raises(ValueError):
            webp_batch.decode_streams([good, bad])


def test_operator(docs, rows, no_docs):
    media = op7.write_media(docs)
    got = sorted(op7.media_digest(media).collect())
    assert len(got) == len(rows)
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert [tuple(r)[:5] for r in got] == sorted(want)
    stored = {r.doc_id: r.media for r in media.collect()}
    assert all(r.media_bytes == len(stored[r.doc_id]) and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in got)
    pixels = op7.read_pixels(media.select("doc_id", "media")).filter("doc_id = 3008").first()
    assert bytes(pixels.pixels).startswith(b"long long") and pixels.width == 144
    assert op7.media_digest(op7.write_media(no_docs)).count() == 0


def test_many_rows_take_several_images():
    payload = op7.pad_payload(bytes(range(256)) * 4000 + b"the end")
    (media,) = op7.store_payloads([payload])
    (images,) = op7.decode_media([media])
    assert len(images) > 100 and b"".join(x.tobytes() for x in images) == payload


def test_features_by_hand():
    x = np.frombuffer(b"aab\xffacb\xff" * 72, dtype=np.uint8).reshape(1, 144, 4)
    assert op7.pixel_features([x]) == "w=144;h=1;min=97;max=255;values=4;modes=97,97,98,255"
