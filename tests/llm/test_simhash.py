import re

import numpy as np
import pytest
import xxhash

from tablemere.llm import simhash
from tablemere.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits=3):
    """fp -> least fp reachable, by comparing all pairs."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        root[f] = f

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def clustered(rng, centres, each, flips):
    out = []
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(each):
            f = c
            for b in rng.integers(0, 64, int(rng.integers(0, flips + 1))):
                f ^= 1 << int(b)
            out.append(f)
    return out


signed = lambda f: f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("text", ["", "One", "a b", "a b c", "A  b\tC d\x0be " * 3, "ÄB ÄB ÄB x", " ".join(f"w{i}" for i in range(700))])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_long_texts_go_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(5000))
    monkeypatch.setattr(simhash, "_CHUNK_WORDS", 300)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("width,tile", [(1, 2048), (2, 2048), (4, 2048), (4, 8), (2, 3)])
def test_links_against_all_pairs(spark, monkeypatch, width, tile):
    rng = np.random.default_rng(width * 100 + tile)
    fps = [*clustered(rng, 8, 30, 4), *clustered(rng, 1, 250, 3), 0, 1, 7, (1 << 64) - 1]
    want = slow_components(fps)
    monkeypatch.setattr(simhash, "segment_bits", lambda n: width)
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 3, tile), "a", "b").collect()}
    for f, c in want.items():
        together = {signed(g) for g in want if want[g] == c}
        assert got.get(signed(f), signed(f)) == (min(together) if len(together) > 1 else signed(f))


def test_packed_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    low = simhash._manhattan(simhash._nibbles(a), simhash._nibbles(b))
    count = lambda v: [(int(v) >> (4 * k) & 15).bit_count() for k in range(16)]
    assert all(int(d) == sum(abs(x - y) for x, y in zip(count(p), count(q), strict=True)) for d, p, q in zip(low, a, b, strict=True))
    assert (low <= np.bitwise_count(a ^ b)).all()


def test_near_duplicates_edges(edge_docs, empty_docs):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(edge_docs).collect()]
    texts = {r["doc_id"]: r["text"] for r in edge_docs.select("doc_id", "text").collect()}
    assert len(rows) == edge_docs.count()
    parts = slow_components([slow_fingerprint(t) for t in texts.values()])
    for i, fp, component in rows:
        f = slow_fingerprint(texts[i])
        assert int(fp, 16) == f and len(fp) == 16
        assert component == min((j for j, t in texts.items() if j is not None and parts[slow_fingerprint(t)] == parts[f]), default=None)
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_one_of_each(spark, edge_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 3, 6, 7, 8, 9, 10, 11, 12, None], key=str)


def test_components(spark):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, int(x)) for x in rng.integers(1001, 3000, 300)]
    ring = [(5000 + i, 5000 + (i * 7 + 3) % 50) for i in range(50)]
    edges = path + star + ring + star[:50] + [(9, 9), (None, 4), (4, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
