import hashlib
import random
import zlib

import numpy as np
import pytest

from granary.llm import webp


def picture(rng, h, w, colours=None):
    p = rng.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)
    if colours:
        p = p.reshape(-1)[:colours][rng.integers(0, min(colours, h * w), (h, w))]
    return p


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (17, 16), (40, 33)])
def test_plain_round_trip(size):
    p = picture(np.random.default_rng(1), *size)
    assert (webp.decode_one(webp.encode_one(p)) == p).all()


def test_payloads_in_step():
    """Every payload is read back, whatever stands beside it, and ordinary text becomes shorter."""
    rng = random.Random(2)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(300)]
    prose = [" ".join(rng.choices(vocab, k=n)) for n in (5, 90, 600, 9000)]
    texts = [*prose, "x" * 3000, "ab" * 900, "日本語の文" * 70, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(900)), rng.randbytes(6000).hex(), "", "q", "\0" * 640]
    raw = [t.encode() for t in texts] + [rng.randbytes(5000), b"k" * (webp.LINES * 64 * 3 + 64)]
    raw = [x + b"\0" * (-len(x) % 64 or 64 * (not x)) for x in raw]
    stored = webp.encode_all(raw)
    assert [webp.decode(x).tobytes() for x in stored] == raw
    assert [webp.encode_all([x])[0] for x in raw] == stored
    assert all(len(y) < 0.8 * len(x) for x, y in zip(raw[2:9], stored[2:9])) and len(stored[-1]) < len(raw[-1]) / 30
    assert webp.encode_all([]) == []


def test_references_cache_and_palette_are_used():
    picture = webp.encode_all([("the rain that fell on the stones " * 64).encode(), b"0123456789ABCDEF" * 64])
    assert all(len(x) < 400 for x in picture)
    kinds = [webp.Bits(x[21:]) for x in picture]
    for b in kinds:
        b.read(32)
    assert [b.read(1) and 1 + b.read(2) for b in kinds] == [0, 4]


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    p = picture(np.random.default_rng(mode), 9, 11)
    data = webp.encode_one(p, (("predictor", np.full((3, 3), mode), 2),))
    assert (webp.decode_one(data) == p).all()


def test_all_transforms_with_references_cache_and_groups():
    rng = np.random.default_rng(5)
    p = picture(rng, 23, 19, 40)
    for cache in (0, 1, 6, 11):
        data = webp.encode_one(p, (("predictor", rng.integers(0, 14, (6, 5)), 2), ("cross", picture(rng, 6, 5), 2), ("green",)), cache, True, 2)
        assert (webp.decode_one(data) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    p = picture(np.random.default_rng(colours), 13, 21, colours)
    for cache in (0, 3):
        assert (webp.decode_one(webp.encode_one(p, (("palette",),), cache, True)) == p).all()


def test_references_shorten_repeats():
    p = np.tile(picture(np.random.default_rng(2), 2, 16), (20, 1))
    assert len(webp.encode_one(p, (), 0, True)) < len(webp.encode_one(p)) / 3


def test_damage_is_noticed():
    data = webp.encode_one(picture(np.random.default_rng(3), 8, 8))
    for bad in (b"", data[:20], data[:60], b"RIFX" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(webp.DamagedImage):
            webp.decode_one(bad)


def feature(payload):
    """By plain loops over the pixels."""
    pixels = [payload[k : k + 4] for k in range(0, len(payload), 4)]
    n, light = len(pixels), [sum(p[:3]) for p in pixels]
    means = []
    for k in range(72):
        part = light[k * n // 72 : (k + 1) * n // 72] or [light[k * n // 72]]
        means.append(sum(part) / len(part))
    bits = "".join(str(int(means[9 * y + x + 1] > means[9 * y + x])) for y in range(8) for x in range(8))
    return f"{n // 16}x16 {','.join(str(sum(p[c] for p in pixels) * 100 // n) for c in range(4))} {int(bits, 2):016x}"


def test_the_end_of_a_text_counts_for_its_feature():
    text = ("some words of a text " * 60).encode()[:1024]
    assert feature(text) != feature(text[:-200] + b"Z" * 200)


def test_media_columns(spark):
    random.seed(1)
    long = "".join(random.choice("abcé\n ") for _ in range(1_200_000))
    rows = [(1, "hello", 1), (2, None, 2), (3, "", 3), (4, "x" * 64, 4), (5, "hello", 5), (6, long, 6), (1, "hello", 1), (None, "ñ" * 33, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = webp.media_features(webp.with_media(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text, _ in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = by[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        stored = webp.encode_all([padded])[0]
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == feature(padded)
    shown = {r.doc_id: r for r in webp.media_pixels(webp.with_media(docs)).collect()}
    assert shown[1].pixels == b"hello" + b"\0" * 59 and (shown[1].height, shown[1].width) == (1, 16) and len(shown[6].pixels) == by[6].payload_bytes
    assert by[1][2:] == by[5][2:] and by[2][1:] == by[3][1:]
    assert not webp.media_features(webp.with_media(docs.limit(0))).collect()
