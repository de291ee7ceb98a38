import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablemere.llm import langid
from tablemere.llm.common import read_table, text_buffer
from tablemere.llm.queries import op7_langid

DIR = "/root/testdata/sf0.001"


def slow_phrases(text, trained):
    """Greedy longest matches by searching the coded training text."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in trained:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def code(text):
    return bytes(langid.coded(*text_buffer(pa.array([text])))[0].astype(np.uint8))


@pytest.mark.parametrize("segment", [7, 64, 1024])
def test_phrases_are_longest_matches(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    trained = {"a": ["the cat sat on the mat and then the dog ate it"], "b": ["el gato come en la casa con el perro"], "c": ["漢字 éàü xyz"]}
    texts = ["", "the dog and the cat", "con el gato", "zzz 漢 é ate", "x", "the " * 700, "THE  CAT... sat!!! 42 on"]
    model = langid.build(trained)
    signs, offs = langid.coded(*text_buffer(pa.array(texts)))
    got = model.phrases(signs, offs)
    for k, lang in enumerate(sorted(trained)):
        source = code(trained[lang][0])
        for i, t in enumerate(texts):
            coded = code(t)
            parts = [coded[j : j + segment] for j in range(0, len(coded), segment)]
            # a phrase that is open at a segment's end counts with it
            assert got[i, k] == sum(slow_phrases(p, source) for p in parts), (lang, t)


def test_case_and_marks_dont_matter():
    assert code("É..é,,À 12 à") == code("é é à à") and code("A  \n b") == code("a b")


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in read_table(spark, DIR, "documents").collect()}
    rows = op7_langid(spark, DIR).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.95


def test_edges(spark, edge_docs, empty_docs):
    model = langid.fit(edge_docs)
    assert model.languages == ["en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(edge_docs, model).collect()}
    assert {i for i, p in got.items() if p[0] == "und"} == {3, 4, 5, 12} and got[3] == ("und", 0.0)
    assert langid.predict(empty_docs, model).count() == 0
    none = langid.fit(empty_docs)
    assert {r["lang_pred"] for r in langid.predict(edge_docs, none).collect()} == {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 4)
    seen = {}
    monkeypatch.setattr(langid, "build", lambda texts: seen.update(texts))
    df = spark.range(500).selectExpr("id AS doc_id", "'text ' || id AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS lang")
    langid.fit(df)
    assert set(seen) == {"a", "b"} and all(len(v) == 4 for v in seen.values())


def test_letters_are_those_of_unicode(spark):
    model = langid.build({"a": ["some words here"], "b": ["andere Wörter"]})
    texts = ["½ ²", "①②", "Ⅷ ⅷ", "", "12 !?", "ª", "漢", "x", "é", "½ " * 50_000 + "漢"]
    got = model.classify(*text_buffer(pa.array(texts)))[0]
    assert [g == "und" for g in got] == [True] * 5 + [False] * 5


def test_a_tie_goes_to_the_first_by_name():
    model = langid.build({k: ["the very same training text for each of them, word by word"] for k in ("c", "b", "a")})
    names, score = model.classify(*text_buffer(pa.array(["the same text", "zzz"])))
    assert names == ["a", "a"] and list(score) == [0.5, 0.5]


def test_unequal_training_sizes(spark):
    docs = {}
    for r in read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text").collect():
        docs.setdefault(r["lang"], []).append(r["text"][:1500])
    least = min(docs)
    train = {k: v[: 2 if k == least else 60] for k, v in docs.items()}
    model = langid.build(train)
    test = {k: v[100:160] for k, v in docs.items()}
    right = {k: np.mean([n == k for n in model.classify(*text_buffer(pa.array(v)))[0]]) for k, v in test.items()}
    assert min(right.values()) >= 0.9, right


def test_a_very_long_text_is_parsed_in_parts(monkeypatch):
    model = langid.build({"a": ["the cat sat on the mat"], "b": ["el gato come en casa"]})
    text = "the cat ate el gato " * 5000
    whole = model.classify(*text_buffer(pa.array([text])))
    monkeypatch.setattr(langid, "SLICE_BYTES", 4096)
    parts = model.classify(*text_buffer(pa.array([text])))
    assert whole[0] == parts[0] and whole[1][0] == parts[1][0]
