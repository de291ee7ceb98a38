import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablemere.llm import bpe
from tablemere.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(open(TOKENIZER, "rb").read())


def same(model, library, text):
    want = library.encode(text, add_special_tokens=False)
    assert model.encode(text) == want.ids
    assert model.run(text)[1] == model.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aab e\n's", max_size=80), st.text(alphabet="<|endofxt> ", max_size=40)))
def test_random_texts(model, library, text):
    same(model, library, text)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>c", "a" * 3000, "ab" * 2000 + " " * 500, "\x1c\x1f\x85 x", "don't WE'LL I'd", "漢字" * 300, "0" * 1000 + "=" * 999])
def test_texts(model, library, text):
    same(model, library, text)


def test_every_token(model, library):
    for i in range(0, library.get_vocab_size(), 7):
        text = library.decode([i], skip_special_tokens=False)
        same(model, library, text)


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    small = bpe.BpeModel(open(TOKENIZER, "rb").read())
    same(small, library, "the quick brownish fox jumpedly overed the quickly lazying dogs " * 5)


def test_pieces_by_plain_merging(model):
    def merged(piece):
        ids = [model.id_of[bytes([b])] for b in piece]
        while True:
            ranked = [(model.pair.get(a << 32 | b, 1 << 40), k) for k, (a, b) in enumerate(zip(ids, ids[1:]))]
            if not ranked or min(ranked)[0] == 1 << 40:
                return ids
            k = min(ranked)[1]
            ids[k : k + 2] = [model.id_of[model.token[ids[k]] + model.token[ids[k + 1]]]]

    for piece in (b"", b"unbelievability", b"aaaaaaaaaaa", b"thethethetheth", bytes(range(256)), " été".encode()):
        assert model.encode_piece(piece) == merged(piece)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_refuses_other_kinds(change):
    import json

    spec = json.loads(open(TOKENIZER).read()) | change
    with pytest.raises(ValueError):
        bpe.BpeModel(json.dumps(spec).encode())


def test_frames(spark, library, edge_docs, empty_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    encoded = bpe.encode(edge_docs, TOKENIZER)
    rows = encoded.collect()
    assert len(rows) == edge_docs.count() and all(r["intact"] for r in rows)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows)
    assert all(r["text"] == texts[r["doc_id"]] for r in bpe.decode(encoded, TOKENIZER).collect())
    for r in bpe.round_trip(edge_docs, TOKENIZER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty_docs, TOKENIZER).count() == bpe.encode(empty_docs, TOKENIZER).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), TOKENIZER).first()["text"] is None
