import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import pieces

with open(pieces.default_model(), "rb") as f:
    P = pieces.Pieces(f.read(), seed=3, rate=0.2)
TEXTS = ["", " ", "Hello  world\n\tx y é😀", "The and attion to thanedble the, anea.", "a" * 300, "   lead and trail   ", "ñ́ 日本語 \x00 \r\n", "▁ mark ▁▁x▁", " ▁", "<0x41> <s>"]


def test_agrees_with_the_models_own_encoder_without_dropout():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for t in TEXTS:
        if "▁" not in t:
            assert P.encode(t) == own.encode(t), t


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(0, 3))
def test_lossless(text, variant):
    assert P.decode(P.encode(text, variant)) == text
    assert P.decode(P.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("aenthi▁ oéñ日😀"), max_size=80), st.integers(0, 2**64 - 1)), max_size=12))
def test_many_texts_at_once(texts):
    for keys in ([k for _, k in texts], None):
        ids, begin = P.encode_many([t for t, _ in texts], keys)
        assert [ids[a:z].tolist() for a, z in zip(begin, begin[1:])] == [P.encode(t, k if keys else None) for t, k in texts]


def test_long_words_and_many_skips():
    with open(pieces.default_model(), "rb") as f:
        often = pieces.Pieces(f.read(), rate=0.6)
    texts = ["thereationinghered" * 2 + " " + "anothering" * 4, "x" * 200, "the " * 500]
    ids, begin = often.encode_many(texts, [1, 2, 3])
    assert [ids[a:z].tolist() for a, z in zip(begin, begin[1:])] == [often.encode(t, k) for t, k in zip(texts, [1, 2, 3])]


def test_dropout_varies_and_repeats():
    text = TEXTS[3] * 20
    ids = [P.encode(text, v) for v in range(4)]
    assert len({tuple(x) for x in ids}) == 4 and all(len(x) > len(P.encode(text)) for x in ids)
    assert ids == [P.encode(text, v) for v in range(4)]
    cuts = P.encode(" ".join(["thertionth"] * 200), 1)
    starts = [k for k, x in enumerate(cuts) if P.pieces[x].startswith(pieces.MARK)]
    assert len({tuple(cuts[a:z]) for a, z in zip(starts, starts[1:])}) > 6
    with open(pieces.default_model(), "rb") as f:
        full = pieces.Pieces(f.read(), rate=1.0)
    assert full.decode(full.encode(text, 0)) == text and len(full.encode(text, 0)) == len(text) + 1


def test_documents(spark):
    rows = [(k, t, 5) for k, t in enumerate(TEXTS)] + [(None, "null id", 1), (100, None, 2), (3, TEXTS[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(docs)
    found = got.collect()
    assert len(found) == len(rows) and all(r.lossless for r in found)
    assert len({r.ids_sha256 for r in found if r.doc_id == 3}) == 1
    assert pieces.encode_documents(docs.select("doc_id", "text"), rate=0.0).filter("doc_id = 3").first().ids == P.encode(TEXTS[3])
    back = {r.doc_id: r.text for r in pieces.decode_ids(got).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert pieces.encode_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.Pieces(b"")
