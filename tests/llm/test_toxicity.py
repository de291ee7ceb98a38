import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablemere.llm import toxicity
from tablemere.llm.common import read_table, text_buffer
from tablemere.llm.queries import op6_toxicity

DIR = "/root/testdata/sf0.1"


def slow_feature(word):
    """Weights of gapped subsequences of three within a word and its borders."""
    signs, out = [0, *word, 0], {}
    for i in range(len(signs)):
        for a, b in toxicity.GAPS:
            if i + a + b < len(signs):
                code = signs[i] << 12 | signs[i + a] << 6 | signs[i + a + b]
                out[code] = out.get(code, 0) + toxicity.DECAY ** (a + b - 2)
    return out


def parsed(*texts):
    signs, borders, owner = toxicity.words(*text_buffer(pa.array(texts, pa.string())))
    show = lambda w: "".join(chr(96 + c) if c < 27 else "?" for c in w)
    return [(show(signs[i + 1 : j]), int(o)) for i, j, o in zip(borders[:-1], borders[1:], owner, strict=True)]


def test_words():
    assert parsed("The  cat!", None, "", "x", "i d i-o t now", "a bc d") == [("the", 0), ("cat", 0), ("x", 3), ("id", 4), ("io", 4), ("t", 4), ("now", 4), ("a", 5), ("bc", 5), ("d", 5)]
    assert parsed("i d i o t", "x y", "z", "q") == [("idiot", 0), ("xy", 1), ("z", 2), ("q", 3)]
    assert parsed("I.D.I.O.T idi*ot é") == [("idiot", 0), ("idiot", 0), ("?", 0)]
    assert parsed() == [] and parsed("", " ") == []


def test_kernel_against_slow_features():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(1, 27, int(n)).astype(np.uint8)) for n in rng.integers(1, 12, 40)]
    marks = [toxicity._features(w) for w in words[:7]]
    got = toxicity._kernel(words, marks)
    norm = lambda w: float(toxicity._norms(np.array([len(w)]))[0])
    for i, w in enumerate(words):
        a = slow_feature(w)
        for k in range(7):
            b = slow_feature(words[k])
            assert got[i, k] == pytest.approx(sum(v * b.get(c, 0) for c, v in a.items()) / norm(w) / norm(words[k]), rel=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    from tablemere.llm.common import crc_mod

    return toxicity.fit(read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels").where(crc_mod("doc_id", 5) != 0))


def chance(model, *texts):
    return model.probability(*text_buffer(pa.array(texts, pa.string())))


def test_gaps_and_inserted_characters(model):
    clean = "The ounea thst and in erentle wheren thation. "
    for word in ("idiot", "worthless", "pathetic", "disgusting"):
        shapes = [word, word.upper() + "!", " ".join(word), ".".join(word), "-".join(word), word[:3] + "*" + word[3:], word[:2] + word[1:]]
        assert (chance(model, *[f"{clean}{s} {clean}" for s in shapes]) > 0.5).all(), word
    assert (chance(model, clean, clean * 40, "", None) < 0.5).all()


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, DIR, "labels").collect()}
    rows = op6_toxicity(spark, DIR).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits = sum(p == y == 1 for p, y in held)
    # some labelled texts hold no insult at all here, and some languages' insults are made of common syllables
    assert hits / max(1, sum(y for _, y in held)) >= 0.8 and hits / max(1, sum(p for p, _ in held)) >= 0.9


@pytest.mark.parametrize("labels", ["SELECT 1L AS doc_id, 1 AS toxic WHERE 1 = 0", "SELECT * FROM VALUES (1L, 1), (2L, 0), (NULL, 1), (7L, NULL), (3L, 1), (4L, 0), (1L, 1) AS t(doc_id, toxic)"])
def test_edges(spark, edge_docs, empty_docs, labels):
    model = toxicity.fit(edge_docs, spark.sql(labels))
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty_docs, model).count() == 0


def test_a_very_long_text_is_read_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.ToxicModel(rng.normal(size=toxicity._SIZE).astype(np.float32), -0.1, np.ones((2, toxicity.TOP)), np.zeros(2))
    parts = np.array(["a", "b c", "word", "i d i o t", "é", "x9y", "two  words", "\n", "-", "longer", "z"])
    for _ in range(20):
        data, offs = text_buffer(pa.array([" ".join(rng.choice(parts, 300))]))
        want = model.margins(data, offs)
        monkeypatch.setattr(toxicity, "SLICE_BYTES", 40)
        got = model.margins(data, offs)
        monkeypatch.undo()
        np.testing.assert_allclose(got, want, atol=1e-9)
