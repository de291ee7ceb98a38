import numpy as np
import pytest

from tablemere.llm import vectors


def slow(rows, least):
    """vec_id -> (links, component) row by row; by all pairs in double precision."""
    ok = []
    for i, v in rows:
        a = None if v is None or not len(v) or any(x is None for x in v) else np.array(v, np.float64)
        ok.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = [None if a is None else vectors.unit(a[None])[0] for a in ok]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for k in range(n):
        members.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], links[k], min([x for x in members[find(k)] if x is not None], default=None)) for k in range(n)) if all(r[0] is not None for r in rows) else None


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "'x' AS cid", "1 AS n", "2 AS label")
    out = vectors.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out)


def clusters(rng, groups, each, dims, spread):
    rows = []
    for _ in range(groups):
        c = rng.normal(size=dims)
        rows += [c + rng.normal(size=dims) * spread * rng.random() for _ in range(each)]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("dims,tile,tiles", [(64, 8192, 16), (64, 16, 16), (3, 40, 4), (24, 8192, 1)])
def test_against_all_pairs(spark, monkeypatch, dims, tile, tiles):
    monkeypatch.setattr(vectors, "TILES", tiles)
    rng = np.random.default_rng(dims + tile)
    rows = clusters(rng, 25, 12, dims, 0.4)
    assert made(spark, rows, tile_rows=tile) == slow(rows, 0.95)


def test_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILES", 4)
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(200)] + [(300 + k, [1.0, 2.0, 3.0 + k / 1000]) for k in range(60)]
    rows += [(500 + k, [float(np.float32(x)) for x in rng.normal(size=3)]) for k in range(40)]
    assert made(spark, rows, tile_rows=20) == slow(rows, 0.95)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
        (10, [1e30, 1e30]), (11, [1e-30, 1e-30]), (12, [-1.0, 0.0]), (13, [1.0, 0.0]), (13, [1.0, 0.0]), (14, [-0.0, 1.0]), (15, [0.0, 1.0]),
    ]
    assert made(spark, rows) == slow(rows, 0.95)
    got = vectors.near_duplicates(spark.createDataFrame([(None, [1.0]), (3, [1.0]), (None, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == [(3, 1, 3), (None, 0, None), (None, 1, 3)]
    assert made(spark, []) == []
    assert made(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("least", [0.5, 0.95, 0.999])
def test_tiles_lose_no_link(least):
    rng = np.random.default_rng(9)
    a, b = (vectors.unit(rng.normal(size=(n, 40)) + 2 * rng.normal(size=40)[None] * (rng.random((n, 1)) < 0.3)) for n in (300, 200))
    b[:50] = vectors.unit(a[:50] + rng.normal(size=(50, 40)) * 0.02)
    for axes in (vectors.rotation(a), np.linalg.qr(rng.normal(size=(40, 40)))[0]):
        i, j = vectors.tile_links(a, b, axes, least)
        x, y = np.nonzero(a @ b.T >= least)
        assert sorted(zip(i, j, strict=True)) == sorted(zip(x, y, strict=True))
