import itertools

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tablemere.llm import shingles, simhash

WORDS = [f"w{i}" for i in range(400)]


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_firsts(rows):
    """id -> least id of its component, by comparing all pairs."""
    sets, root = {i: slow_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"e{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng, texts = np.random.default_rng(5), ["", "one", "a b c d", "a b c d"]
    line = " ".join(rng.choice(WORDS, 40))
    for _ in range(12):
        own = rng.choice(WORDS, int(rng.integers(30, 400)))
        texts += [edited(rng, own, int(k)) for k in rng.integers(0, 2 + len(own) // 30, 8)]
        texts.append(line + " " + " ".join(rng.choice(WORDS, 12)))  # mostly a common line
    return list(enumerate(texts))


@pytest.mark.parametrize("tile,sample", [(512, 4000), (3, 4000), (512, 0)])
def test_against_all_pairs(spark, monkeypatch, rows, tile, sample):
    links, common = shingles.links, shingles.common_shingles
    monkeypatch.setattr(shingles, "links", lambda d, percent: links(d, percent, tile))
    monkeypatch.setattr(shingles, "common_shingles", lambda *a: common(*a)[: sample or 0])
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = slow_firsts(rows)
    assert len(set(want.values())) < len(rows) and {r["_id"]: r["component_id"] for r in got.collect()} == want


def test_prefixes_share_enough_keys():
    rng = np.random.default_rng(8)
    for percent in (30, 50, 80, 95):
        for _ in range(300):
            both = rng.choice(1000, int(rng.integers(1, 60)), replace=False).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(1000, 2000, int(rng.integers(0, 6))).astype(np.uint64)))) for _ in range(2))
            same, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if same != every and same * 100 >= percent * every:
                common = np.sort(rng.choice(2000, 300, replace=False)).astype(np.uint64)
                assert len(np.intersect1d(shingles.prefix(a, common, percent), shingles.prefix(b, common, percent))) >= shingles._shared(percent)


def test_parities_fold_to_those_of_a_narrower_width():
    sets = [np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 700, 3000)]
    rows = pa.array([[], *[shingles.parities(x).view(np.int64) for x in sets]], pa.list_(pa.int64())).slice(1)
    assert rows.value_lengths().to_pylist() == [16, 32, 128]
    assert (shingles.stacked([rows[:1], rows[1:]]) == np.stack([shingles.parities(x, 1024) for x in sets])).all()
    assert (shingles.stacked([rows[2:]]) == shingles.parities(sets[2])).all()


@pytest.mark.parametrize("listed", [2, 32])
def test_long_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch, listed):
    monkeypatch.setattr(shingles, "LISTED", listed)
    rng = np.random.default_rng(3)
    texts = [" ".join([*rng.choice(WORDS, 4000), *WORDS[:100]]) for _ in range(4)]  # one passage in all of them
    own = rng.choice(WORDS, 6000)
    texts += [" ".join(own), edited(rng, own, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = shingles.classes_of(shingles._prefixes(docs, "doc_id", "text", 5, np.zeros(0, np.uint64), shingles.PERCENT)).cache()
    keys = sorted(shingles._name(shingles.shingle_set(t.encode())) for t in texts[4:])
    edges = shingles.candidates(classes, shingles.PERCENT, shingles.Scratch(spark)).collect()
    assert len(edges) == 1 and sorted(np.array([*edges[0]]).view(np.uint64).tolist()) == keys


def test_a_passage_in_a_part_of_the_texts_crowds_no_key(spark, monkeypatch):
    crowds, crowded = [], shingles._crowded
    monkeypatch.setattr(shingles, "SAMPLE", 50)  # a fiftieth of the texts, none of the passage's or few, however many there are
    monkeypatch.setattr(shingles, "_crowded", lambda rows, percent: crowds.append(rows.count()) or crowded(rows, percent))
    rng = np.random.default_rng(9)
    texts = [[f"u{w}" for w in rng.integers(1 << 40, size=30)] for _ in range(2500)]
    for words in texts[:50]:
        words += WORDS[:16]
    texts[60] = ["other", *texts[0][1:]]  # and one near copy
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["_id"]: r["component_id"] for r in got.collect() if r["_id"] != r["component_id"]} == {60: 0}
    assert crowds == []  # the passage's shingles are known as common ones, and other ones fill the prefixes


def test_common_shingles_by_level(spark, monkeypatch):
    words = [f"{a} {a}1 {a}2 {a}3 {a}4" for a in "abcd"]  # held by 1, 2, 4 and 9 texts, each but the first by a copy too
    texts = [f"u{i} {w}" for w, n in zip(words, (1, 2, 4, 9), strict=True) for i in range(n)]
    docs = spark.createDataFrame([(t,) for t in texts + texts], "text string").repartition(3)
    held = np.concatenate([shingles.shingle_set(w.encode()) for w in words])
    assert shingles.common_shingles(docs, "text", 5).tolist() == sorted(np.repeat(held, (0, 1, 2, 3)).tolist())
    monkeypatch.setattr(shingles, "MOST_COMMON", 2)
    assert shingles.common_shingles(docs, "text", 5).tolist() == sorted(np.repeat(held, (0, 0, 1, 2)).tolist())
    assert shingles.common_shingles(docs.limit(0), "text", 5).tolist() == []


def test_prefixes_have_rarer_shingles_first():
    hashes = np.arange(10, dtype=np.uint64)
    common = np.sort(np.repeat(hashes[:8], (3, 1, 1, 2, 2, 1, 3, 1)))
    assert shingles.prefix(hashes, common).tolist() == [8, 9, 1, 2, 5]


@pytest.mark.parametrize("cell", [2048, 3])
def test_crowded_keys_against_all_pairs(spark, monkeypatch, rows, cell):
    monkeypatch.setattr(shingles, "LISTED", 2)
    monkeypatch.setattr(shingles, "CELL_ROWS", cell)
    monkeypatch.setattr(shingles, "_PAIRS", 16)
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["_id"]: r["component_id"] for r in got.collect()} == slow_firsts(rows)


def bits_apart(a, b):
    x, y = (simhash.majority(shingles.shingle_set(t.encode())) for t in (a, b))
    return (x ^ y).bit_count()


def one_change(rng, words):
    """A copy with one word changed, and a fingerprint within the grid's bits."""
    copies = (edited(rng, words, 1) for _ in range(1000))
    return next(t for t in copies if bits_apart(t, " ".join(words)) <= shingles.BITS)


def test_the_grid_finds_copies_without_the_prefix_filter(spark, monkeypatch):
    monkeypatch.setattr(shingles, "candidates", lambda classes, percent, scratch: scratch.put("candidates", spark.createDataFrame([], "a long, b long")))
    rng, texts = np.random.default_rng(4), [""]
    for n in (60, 300, 2000):
        own = rng.choice(WORDS, n)
        texts += [" ".join(own), one_change(rng, own), " ".join(own).upper()]
    got = shingles.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 7}


def test_what_the_grid_found_is_not_compared_again(spark, monkeypatch):
    compared, links = [], shingles.links
    monkeypatch.setattr(shingles, "links", lambda d, percent: compared.append(d.count()) or links(d, percent))
    rng = np.random.default_rng(6)
    own, other = rng.choice(WORDS, 300), rng.choice(WORDS, 300)
    far = next(t for t in (edited(rng, other, 4) for _ in range(1000)) if bits_apart(t, " ".join(other)) > shingles.BITS)
    rows = list(enumerate([" ".join(own), one_change(rng, own), " ".join(other), far]))
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["_id"]: r["component_id"] for r in got.collect()} == slow_firsts(rows) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert compared == [2, 2]  # one pair by the grid, the other by the prefix filter


def test_the_stage_drops_edited_copies(spark):
    rng = np.random.default_rng(1)
    own = rng.choice(WORDS, 300)
    rows = [(1, " ".join(own)), (2, edited(rng, own, 5)), (3, " ".join(rng.choice(WORDS, 300)))]
    assert [i for i, j in slow_firsts(rows).items() if i == j] == [1, 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_edges(edge_docs, empty_docs):
    kept = shingles.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted([1, 3, 6, 7, 8, 9, 10, 11, 12, None], key=str)
    assert shingles.one_of_each(empty_docs).count() == 0
