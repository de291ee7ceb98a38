"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import bounded_sample, checkpoint, let, prepare_workers
from tablemere.llm.components import connected_components, contracted, star_edges

#: Rows the rotation and the ranges are fitted on; they steer the work, never the result.
FIT_ROWS = 20_000
#: Most components in a tile (about 40 bytes each in a worker), fewest rows it is cut to for that, number of tiles aimed at, most ranges of the leading component.
TILE_CELLS, TILE_ROWS, TILES, RANGES = 1 << 21, 512, 16, 4096
#: Leading dimensions of the first pass and of each further one.
LEAD, STEP = 16, 16
#: Rows of a block of a tile, and pairs that go on at once.
_BLOCK, _PAIRS = 1024, 1 << 18
_SLACK = 1e-4  # above the rounding of single precision in the bounds; the last word is in double precision


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(x: np.ndarray) -> np.ndarray:
    """Orthonormal axes of falling variance of the rows of ``x``, as columns."""
    values, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return axes[:, np.argsort(-values)]


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row of a, row of b) whose cosine is at least ``least``; a and b are unit rows.

    Rotated rows are compared on the leading dimensions first. What is left of
    the product is at most the product of the suffix norms; adding the norm as
    one more dimension makes product and bound one matrix product. Pairs that
    can still reach the threshold get the next dimensions, and at last the whole
    product in double precision.
    """
    ra, rb, dims = a @ axes, b @ axes, axes.shape[1]
    steps = [*range(min(LEAD, dims), dims, STEP), dims]
    tails = [[np.sqrt((r[:, k:] ** 2).sum(axis=1)) for k in steps] for r in (ra, rb)]
    ha, hb = (np.hstack((r[:, : steps[0]], t[0][:, None])).astype(np.float32) for r, t in zip((ra, rb), tails, strict=True))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), _BLOCK):
        i, j = np.nonzero(ha[at : at + _BLOCK] @ hb.T >= least - _SLACK)
        i += at
        for lot in range(0, len(i), _PAIRS):
            x, y = i[lot : lot + _PAIRS], j[lot : lot + _PAIRS]
            product = np.einsum("ij,ij->i", ra[x, : steps[0]], rb[y, : steps[0]])
            for s in range(1, len(steps)):
                product += np.einsum("ij,ij->i", ra[x, steps[s - 1] : steps[s]], rb[y, steps[s - 1] : steps[s]])
                live = product + tails[0][s][x] * tails[1][s][y] >= least - _SLACK
                x, y, product = x[live], y[live], product[live]
            true = np.einsum("ij,ij->i", a[x], b[y]) >= least
            found.append((x[true], y[true]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_OUT = "kind int, a long, b long"


def _pair_batch(one: list, two: list, axes: np.ndarray, least: float, same: bool) -> pa.RecordBatch:
    """What a pair of tiles says: kind 0 (row, its linked vectors here), kind 1 star edges."""
    ids, weights = [np.concatenate([p[k] for p in one]) for k in (0, 1)]
    vecs = np.concatenate([p[2] for p in one])
    if same:
        ids2, weights2, vecs2 = ids, weights, vecs
    else:
        ids2, weights2 = [np.concatenate([p[k] for p in two]) for k in (0, 1)]
        vecs2 = np.concatenate([p[2] for p in two])
    i, j = tile_links(vecs, vecs2, axes, least)
    if same:
        i, j = i[i < j], j[i < j]
    left = np.bincount(i, weights2[j], len(ids)).astype(np.int64)
    right = np.bincount(j, weights[i], len(ids2)).astype(np.int64)
    a, b = star_edges(ids[i], ids2[j]) if len(i) else (np.zeros(0, np.int64),) * 2
    kind = np.repeat(np.array([0, 0, 1], np.int32), [(left > 0).sum(), (right > 0).sum(), len(a)])
    x = np.concatenate((ids[left > 0], ids2[right > 0], a))
    y = np.concatenate((left[left > 0], right[right > 0], b))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], ["kind", "a", "b"])


def _compare(axes: np.ndarray | None, least: float):
    """Over rows sorted by (pair, side): hold one pair's two tiles at a time. Without axes components stay in their order."""

    def made(one: list, two: list, same: bool) -> pa.RecordBatch:
        return _pair_batch(one, two, np.eye(one[0][2].shape[1]) if axes is None else axes, least, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two, same = None, [], [], False
        for batch in batches:
            pair, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ids, weights = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(pair)], strict=True):
                if i == j:
                    continue
                if pair[i] != now:
                    if now is not None and one and (two or same):
                        yield made(one, two, same)
                    now, one, two = pair[i], [], []
                same = side[i] == 2
                (two if side[i] == 1 else one).append((ids[i:j], weights[i:j], unit(_matrix(batch.column(4).slice(i, j - i)))))
        if now is not None and one and (two or same):
            yield made(one, two, same)

    return run


def _usable(vec: str) -> str:
    """SQL: not null, not empty, all components finite, not all zero."""
    return (
        f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        f" and exists({vec}, x -> x <> 0)"
    )


def near_duplicates(
    table: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vec: str = "embedding", tile_rows: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their vectors' cosine in double precision is at least
    ``least``, whatever else they hold; component_id is the least vec_id that
    links reach, and kept says that it is the row's own. Equal vectors are one
    class from the start. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of another length than the
    most common one are compared with those of their own length. Very long
    vectors make tiles of fewer rows. Rows of equal vec_id count as rows of their
    own; a null vec_id names no component; an empty table gives none. Other
    columns are not read.

    Every tile is compared with those in reach of its range of the leading
    component. Where no direction stands out that is most of them, and the work
    grows with the square of the number of different vectors.
    """
    single = table.schema[vec].dataType.simpleString() == "array<float>"  # half the bytes to move; products are double anyway
    rows = table.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("v"))
    usable = rows.where(_usable("v"))
    classes = checkpoint(
        usable.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("cid", F.monotonically_increasing_id())
    )
    common = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    if common is None:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = _links(classes.where(F.size("v") == common["d"]), common["d"], least, tile_rows or max(TILE_ROWS, TILE_CELLS // common["d"]))
    odd = classes.where(F.size("v") != common["d"])
    if not odd.isEmpty():
        found = found.union(_ragged_links(odd, least, tile_rows))
    found = checkpoint(found)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("near"))
    parts = connected_components(contracted(found.where("kind = 1")), "a", "b").select(F.col("node").alias("cid"), "component")
    named = classes.select("cid", "v", "n", "first").join(counts, "cid", "left").join(parts, "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    firsts = checkpoint(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = checkpoint(
        named.join(firsts, "component").select(
            "v", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id"
        )
    )
    linked = usable.join(named, "v").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.where(f"not ({_usable('v')})").select("id", F.lit(0).cast("long"), "id")
    return linked.union(alone).select(
        F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _links(classes: DataFrame, dims: int, least: float, tile_rows: int) -> DataFrame:
    """Link counts and star edges (kind, a, b) of the classes' vectors, all of ``dims`` components."""
    sample = bounded_sample(classes, "cid", FIT_ROWS).select("v").collect()
    x = unit(np.array([r["v"] for r in sample], np.float64))
    axes = rotation(x)
    lead = axes[:, 0]
    total = classes.count()
    size = max(1, min(tile_rows, -(-total // TILES)))
    ranges = int(min(RANGES, max(1, -(-total // size))))
    borders = np.unique(np.quantile(x @ lead, np.linspace(0, 1, ranges + 1)[1:-1])) if ranges > 1 else np.zeros(0)
    axis = F.array(*[F.lit(float(c)) for c in lead])
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + c)

    def place(w: Column) -> Column:
        """Leading component of the unit vector."""
        dot = total_of(F.zip_with(w, axis, lambda a, b: a * b))
        return let(F.array_max(F.transform(w, F.abs)), lambda m: dot / (F.sqrt(total_of(F.transform(w, lambda c: (c / m) * (c / m)))) * m))

    edges = F.array(*[F.lit(float(c)) for c in borders]).cast("array<double>")
    at = let(let(F.col("v").cast("array<double>"), place), lambda p: F.size(F.filter(edges, lambda c: c < p)))
    ranged = checkpoint(classes.select("cid", "n", "v", at.cast("long").alias("r")))
    sizes = {r["r"]: r["n"] for r in ranged.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}  # RANGES at most
    own = np.array(sorted(sizes))
    cuts = np.array([-(-sizes[r] // size) for r in own.tolist()])
    first = np.concatenate(([0], np.cumsum(cuts)))
    tiles = int(first[-1])
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6  # unit vectors farther apart than this in one direction can't link
    low, high = np.concatenate(([-2.0], borders))[own], np.concatenate((borders, [2.0]))[own]
    begin, end = np.searchsorted(high, low - reach), np.searchsorted(low, high + reach, side="right")
    spark = classes.sparkSession
    partners = spark.createDataFrame(
        list(zip(own.tolist(), first[:-1].tolist(), cuts.tolist(), first[begin].tolist(), first[end].tolist(), strict=True)),
        "r long, f long, c long, from_tile long, to_tile long",
    )
    placed = ranged.join(F.broadcast(partners), "r").withColumn("t", F.col("f") + F.pmod(F.xxhash64("cid"), "c"))
    spread = placed.select(
        F.explode(F.sequence(F.col("from_tile"), F.col("to_tile") - 1)).alias("u"), "t", "cid", "n", "v"
    ).select(
        (F.least("t", "u") * F.lit(tiles) + F.greatest("t", "u")).alias("pair"),
        F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1).alias("side"), "cid", "n", "v",
    )
    prepare_workers(spark)
    ordered = spread.repartition("pair").sortWithinPartitions("pair", "side")
    return ordered.mapInArrow(_compare(axes, least), _OUT)


def _ragged_links(classes: DataFrame, least: float, tile_rows: int | None) -> DataFrame:
    """What ``_links`` gives, for vectors of any lengths, each compared with all of its own length, in one job."""
    sized = classes.select("cid", "n", "v", F.size("v").alias("d"))
    rows = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(TILE_ROWS), F.floor(F.lit(TILE_CELLS) / F.col("d")))
    cuts = checkpoint(sized.groupBy("d").agg(F.count(F.lit(1)).alias("c")).select("d", F.ceil(F.col("c") / rows).cast("long").alias("k")))
    placed = sized.join(cuts, "d").withColumn("t", F.pmod(F.xxhash64("cid"), "k")).withColumn("u", F.explode(F.expr("sequence(0L, k - 1)")))
    width = F.lit(1 << 20)  # more tiles of one length than that are beyond any table
    pair = (F.col("d") * width + F.least("t", "u")) * width + F.greatest("t", "u")
    side = F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1)
    prepare_workers(classes.sparkSession)
    ordered = placed.select(pair.alias("pair"), side.alias("side"), "cid", "n", "v").repartition("pair").sortWithinPartitions("pair", "side")
    return ordered.mapInArrow(_compare(None, least), _OUT)


#: For tables whose vectors are all usable and have ids of their own, as the generated ones.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT l.x, c.r FROM l JOIN c ON l.y = c.vec_id),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT m.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN n ON m.vec_id = n.x
"""
