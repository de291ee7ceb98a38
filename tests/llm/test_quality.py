import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablemere.llm import boosting, quality
from tablemere.llm.common import read_table, text_buffer
from tablemere.llm.queries import op2_quality

DIR = "/root/testdata/sf0.01"


def slow_statistics(text):
    raw, out = text.encode(), {}
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    kinds = Counter(int(quality._CLASS[b]) for b in raw)
    share = lambda k: kinds[k] / max(1, len(raw))
    grams = lambda n: (len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / max(1, len(words) - n + 1)) if len(words) >= n else 0
    many = max(1, len(words))
    out["log_bytes"] = math.log1p(len(raw))
    for name, k in zip(quality.FEATURES[1:10], (0, 1, 2, 3, 4, 5, 6, 7, 8), strict=True):
        out[name] = share(k)
    out |= {"log_words": math.log1p(len(words)), "word_bytes": sum(map(len, words)) / many, "distinct_words": len(set(words)) / many}
    out |= {"same_as_last": sum(a == b for a, b in zip(words, words[1:])) / many, "distinct_pairs": grams(2), "distinct_fives": grams(5)}
    out["symbol_words"] = sum(bool(re.search(rb"[#*$%&|<>!]", w)) for w in words) / many
    out["bare_words"] = sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words) / many
    out |= {"log_lines": math.log1p(len(lines)), "line_bytes": sum(map(len, lines)) / max(1, len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines))}
    return [out[f] for f in quality.FEATURES]


def test_statistics():
    texts = ["", "a", "a b a b\nx y\n\nx y\nHELLO!! #x 12\n", None, "\n", "é è  é\n", "w " * 30, "x", "x y", "a\na\na", " lead", "trail ", "a b c d e a b c d e f", "l\r\nl\r\n"]
    got = quality.statistics(*text_buffer(pa.array(texts)))
    np.testing.assert_allclose(got, [slow_statistics(t or "") for t in texts], atol=1e-12)
    assert quality.statistics(*text_buffer(pa.array([], pa.string()))).shape == (0, len(quality.FEATURES))


def walk(forest, row):
    total = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    return total


def test_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] * x[:, 2] > 0)).astype(int)
    forest = boosting.train(x[:1000], y[:1000])
    np.testing.assert_allclose(forest.margin(x[:50]), [walk(forest, r) for r in x[:50]])
    assert ((forest.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.85
    for none in (boosting.train(x[:0], y[:0]), boosting.train(x[:9], np.ones(9))):
        assert 0 < none.probability(x[:3]).min() and none.probability(x[:3]).max() < 1
    odd = boosting.train(np.array([[np.nan, 1.0], [np.inf, 1.0], [0.0, 1.0], [1.0, 1.0]] * 9), np.array([0, 1, 0, 1] * 9))
    assert np.isfinite(odd.probability(np.array([[0.0, 1.0]]))).all()


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, DIR, "labels").collect()}
    rows = op2_quality(spark, DIR).collect()
    assert len(rows) == read_table(spark, DIR, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_labels_of_held_out_rows_have_no_effect(spark):
    from tablemere.llm.common import crc_mod

    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.fit(docs, x.where(crc_mod("doc_id", 5) != 0)) for x in (labels, turned))
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()


@pytest.mark.parametrize("labels", ["SELECT 1L AS doc_id, 1 AS quality WHERE 1 = 0", "SELECT * FROM VALUES (1L, 1), (2L, 0), (NULL, 1), (7L, NULL), (9L, 3), (1L, 1) AS t(doc_id, quality)"])
def test_edges(spark, edge_docs, empty_docs, labels):
    forest = quality.fit(edge_docs, spark.sql(labels))
    rows = quality.score(edge_docs, forest).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(empty_docs, forest).count() == 0


def test_a_long_text_in_parts_has_the_whole_s_statistics(monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array(["a", "bb", "é", "long" * 30, "x#", "12", "!", "\n", "\n\n", "Word", "the"])
    for k in range(30):
        text = " ".join(rng.choice(words, int(rng.integers(0, 400)))) + ["", " ", "\n", " x"][k % 4]
        buffer = text_buffer(pa.array([text]))
        want = quality.statistics(*buffer)
        for size in (1, 7, 64, 1000):
            np.testing.assert_allclose(quality._long_statistics(buffer[0], size), want[0], atol=1e-12)
    monkeypatch.setattr(quality, "SLICE_BYTES", 100)
    long = "one two three four five six\n" * 50
    np.testing.assert_allclose(quality.statistics(*text_buffer(pa.array([long])))[0], slow_statistics(long), atol=1e-12)


def test_memory_of_a_text_of_100_mb():
    code = """
import resource, numpy as np
from tablemere.llm import langid, quality
rng = np.random.default_rng(1)
words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(2, 12, 20000)]
data = np.frombuffer(b" ".join(words[k] for k in rng.integers(0, len(words), 1 << 17)) * 130, np.uint8)[:100_000_000]
offs, model = np.array([0, len(data)]), langid.build({"a": ["the cat sat"], "b": ["el gato"]})
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = used()
quality.statistics(data, offs)
one = used() - before
langid.LanguageModel.classify(model, data, offs)
print(one, used() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert all(float(x) < 1000 for x in out), out
