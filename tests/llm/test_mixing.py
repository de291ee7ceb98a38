import math
import re
from collections import Counter

import pytest

from tablemere.llm import mixing


def docs_of(spark, sizes):
    """sizes: source -> list of token counts."""
    rows, at = [], 0
    for s, counts in sizes.items():
        for n in counts:
            rows.append((at, " ".join(["w"] * n), s))
            at += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


SIZES = {"a": [100 + k % 7 for k in range(90)], "b": [50 + k % 5 for k in range(40)], "c": [20] * 30, None: [30] * 10, "empty": [0, 0]}


def shares(sizes):
    t = {k: sum(v) for k, v in sizes.items()}
    return t, {k: v / sum(t.values()) for k, v in t.items() if v}


def used(df):
    rows = df.collect()
    tokens, times = Counter(), Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
        times[r["doc_id"]] += 1
    return rows, tokens, times


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w) / math.log(len(weights))


@pytest.mark.parametrize("budget,blocks", [(1.0, 1 << 16), (0.4, 64), (2.5, 200), (None, 64)])
def test_budgets(spark, monkeypatch, budget, blocks):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", blocks)
    docs = docs_of(spark, SIZES)
    rows, tokens, times = used(mixing.mix(docs, entropy=0.9, repeat_limit=50.0, budget=budget))
    total, share = shares(SIZES)
    weights = {r["source"]: r["weight"] for r in rows if r["source"] != "empty"}
    assert sum(weights.values()) == pytest.approx(1) and entropy(weights.values()) == pytest.approx(0.9, abs=1e-6)
    exponent = {math.log(weights[k] / weights["a"]) / math.log(share[k] / share["a"]) for k in weights if k != "a"}
    assert max(exponent) - min(exponent) < 1e-9 and 0 < min(exponent) < 1
    size = 1 / min(weights[k] / share[k] for k in weights) if budget is None else budget
    whole = sum(total.values())
    for k, w in weights.items():
        # a budget is met by the document that reaches it
        assert 0 <= tokens[k] - round(w * size * whole - 1e-6) <= max(SIZES[k]) + 1
    for r in rows:
        assert times[r["doc_id"]] in (int(weights[r["source"]] / share[r["source"]] * size + 1e-9) + d for d in (0, 1)) if r["source"] != "empty" else times[r["doc_id"]] == 1
    if budget is None:
        assert len(times) == docs.count()
    per_epoch = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert max(per_epoch.values()) == 1


@pytest.mark.parametrize("wanted", [0.3, 0.5, 0.7, 0.99])
@pytest.mark.parametrize("driver", [100_000, 0])
def test_entropy_is_met_from_either_side(spark, monkeypatch, wanted, driver):
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", driver)
    _, share = shares(SIZES)
    own = entropy(share.values())
    assert 0.5 < own < 0.7
    plan = mixing.source_plan(spark.createDataFrame([(str(k), sum(v)) for k, v in SIZES.items()], "key string, tokens long"), wanted, 1000.0)
    weights = {r["key"]: r["weight"] for r in plan.collect() if r["tokens"]}
    assert entropy(weights.values()) == pytest.approx(wanted, abs=1e-6) and sum(weights.values()) == pytest.approx(1)
    largest = max(share, key=share.get)
    assert (weights[str(largest)] > share[largest]) == (wanted < own)


def test_sources_tied_for_the_largest(spark):
    rows = mixing.mix(docs_of(spark, {"a": [10] * 30, "b": [10] * 30, "c": [10] * 3}), entropy=0.1).collect()
    weights = {r["source"]: r["weight"] for r in rows}
    assert weights["a"] == weights["b"] and sum(weights.values()) == pytest.approx(1, abs=1e-9)


def slow_mix(sizes, want, limit, budget):
    """source -> (weight, tokens wanted) by a fine search over exponents."""
    total, share = shares(sizes)
    best = None
    for k in range(0, 8001):
        a = k / 1000
        z = sum(s**a for s in share.values())
        w = {x: s**a / z for x, s in share.items()}
        if max(w[x] / share[x] for x in w) * budget <= limit + 1e-9:
            miss = abs(entropy(w.values()) - want)
            best = min(best or (9, w), (miss, w), key=lambda x: x[0])
    return {x: (v, v * budget * sum(total.values())) for x, v in best[1].items()}


@pytest.mark.parametrize("want,limit,budget", [(0.5, 4.0, 1.0), (0.9, 2.5, 1.0), (0.4, 1.1, 0.7), (0.75, 4.0, 1.7)])
def test_against_a_search_over_exponents(spark, want, limit, budget):
    rows, tokens, _ = used(mixing.mix(docs_of(spark, SIZES), entropy=want, repeat_limit=limit, budget=budget))
    weights = {r["source"]: r["weight"] for r in rows}
    for k, (weight, amount) in slow_mix(SIZES, want, limit, budget).items():
        assert weights.get(k, weight) == pytest.approx(weight, abs=2e-3)
        assert abs(tokens[k] - amount) <= max(SIZES[k]) + 0.002 * sum(map(sum, SIZES.values())) * budget


@pytest.mark.parametrize("bits", [52, 62])
def test_the_cut_is_at_the_document_that_meets_the_budget(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(mixing, "PART_BITS", bits)
    docs = docs_of(spark, SIZES)
    every = mixing.mix(docs, entropy=0.9, repeat_limit=50.0, budget=30.0).collect()
    rows, tokens, _ = used(mixing.mix(docs, entropy=0.9, repeat_limit=50.0, budget=1.0))
    for k in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == k]
        last = max(r["epoch"] for r in own)
        order = lambda r: (r["block"], r["place"])
        whole = sorted((r for r in every if r["source"] == k and r["epoch"] == last), key=order)
        part = sorted((r for r in own if r["epoch"] == last), key=order)
        assert [r["doc_id"] for r in part] == [r["doc_id"] for r in whole][: len(part)]  # a prefix of that epoch's permutation


def test_epochs_are_different_permutations(spark):
    rows = mixing.mix(docs_of(spark, {"a": [10] * 40, "b": [10] * 400}), entropy=0.99, repeat_limit=50.0, budget=2.0).collect()
    order = {e: [r["doc_id"] for r in sorted((r for r in rows if r["source"] == "a" and r["epoch"] == e), key=lambda r: (r["block"], r["place"]))] for e in (0, 1, 2)}
    assert sorted(order[0]) == sorted(order[1]) == sorted(order[2]) == list(range(40))
    assert order[0] != order[1] != order[2] and order[0] != sorted(order[0])


@pytest.mark.parametrize("limit", [1.0, 1.2, 1.5, 4.0])
def test_repetition_limit(spark, limit):
    rows, _, times = used(mixing.mix(docs_of(spark, SIZES), entropy=1.0, repeat_limit=limit))
    _, share = shares(SIZES)
    most = max(r["weight"] / share[r["source"]] for r in rows if r["source"] != "empty")
    assert most <= limit + 1e-9
    free = max(1 / 4 / s for s in share.values())  # at equal weights
    assert most == pytest.approx(min(limit, free), rel=1e-6)


def test_many_sources_stay_off_the_driver(spark, monkeypatch):
    docs = docs_of(spark, SIZES)
    want = sorted(map(str, mixing.mix(docs, entropy=0.93).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs, entropy=0.93).collect())) == want


def test_one_hot_source_and_one_source(spark):
    rows, tokens, _ = used(mixing.mix(docs_of(spark, {"hot": [100] * 300, "b": [100] * 3}), entropy=0.95, repeat_limit=1000.0))
    assert tokens["b"] / sum(tokens.values()) > 0.3
    docs = docs_of(spark, {"a": [5] * 20})
    assert mixing.mix(docs).count() == 20 and mixing.mix(docs, budget=None).count() == 20
    assert 10 <= mixing.mix(docs, budget=0.5).count() <= 11


def test_edges(spark, edge_docs, empty_docs):
    out = mixing.mix(edge_docs, budget=None)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in edge_docs.collect()}
    carried = mixing.mix(edge_docs, budget=None, carry=True)
    assert carried.schema == edge_docs.schema and carried.count() == out.count() >= edge_docs.count()
    assert mixing.mix(empty_docs).count() == mixing.mix(empty_docs, carry=True).count() == 0
    assert mixing.mix(edge_docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "source")).count() == edge_docs.count()


def test_plan_is_native(edge_docs):
    assert not re.search("Python|Pandas|Arrow", mixing.mix(edge_docs)._jdf.queryExecution().toString())
