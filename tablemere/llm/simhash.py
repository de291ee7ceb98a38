"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import checkpoint, map_texts, prepare_workers
from tablemere.llm.components import connected_components, contracted, star_edges

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_CHUNK_WORDS = 1 << 16
#: Most rows of one side of a grid cell that one tile compares.
TILE_ROWS = 2048
#: Most large cells (24 bytes each) or ids to drop whose list is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Pairs compared at once in a worker.
_PAIRS = 1 << 20


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        return np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes: the bits set in over half of them."""
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(2 * _bit_counts(hashes) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one text over word shingles with repeats; no word gives zero."""
    words = text.lower().split()  # on bytes: A-Z alone is lowered, \x20 and \x09-\x0D alone split
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return int(hashes[0])
    total, ones, digest = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK_WORDS):
        part = words[at : at + _CHUNK_WORDS + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(part) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        ones += _bit_counts(np.fromiter([digest(joined[i:j], 42) for i, j in spans], np.uint64))
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text; a null text counts as empty."""

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        made = [fingerprint(raw[i:j], shingle) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return {"fp": np.array(made, np.uint64).view(np.int64)}

    return map_texts(docs, run, [doc_id], text, "fp long")


def segment_bits(n: int) -> int:
    """Segment width by the number of distinct fingerprints: narrower segments make finer grids.

    With random fingerprints a half's grid leaves about n * (sum of p^2) ** (32 / w)
    rows of a cell to compare with; the widest w with fewer than 2,000 is taken.
    Results are the same for every width.
    """
    for width in (4, 2):
        p = np.array([1.0])
        for _ in range(width):
            p = np.convolve(p, [0.5, 0.5])
        if n * float((p**2).sum()) ** (32 // width) < 2000:
            return width
    return 1


def _grid_rows(classes: DataFrame, width: int) -> DataFrame:
    """Rows (half, cell, probe, fp) of the grid over each half's segment popcounts.

    At most 3 differing bits leave one half of 32 bits with at most one. The
    Manhattan distance of the halves' popcount vectors is a lower bound of that,
    so the two vectors are equal or one unit step apart: each fingerprint stands
    in its own cell and probes its own and every cell one step up.
    """
    count, mask = 32 // width, (1 << width) - 1
    halves = []
    for half in range(2):
        code = None
        steps = []
        for k in range(count):
            seg = F.bit_count(F.shiftrightunsigned("fp", 32 * half + width * k).bitwiseAND(F.lit(mask))).cast("long")
            place = (width + 1) ** k if width > 1 else 1 << k
            code = seg * place if code is None else code + seg * place
            steps.append(F.when(seg < width, F.lit(place).cast("long")))
        halves.append((half, code, F.array_compact(F.array(F.lit(0).cast("long"), *steps))))
    # probe 0 stands in its cell, probe 1 asks there
    stand = [F.struct(F.lit(h).alias("half"), c.alias("cell"), F.lit(0).alias("probe")) for h, c, _ in halves]

    def ask(half: int, code: Column):
        return lambda d: F.struct(F.lit(half).alias("half"), (code + d).alias("cell"), F.lit(1).alias("probe"))

    asks = [F.transform(up, ask(h, c)) for h, c, up in halves]
    return classes.select("fp", F.explode(F.concat(F.array(*stand), *asks)).alias("g")).select(
        "g.half", "g.cell", "g.probe", "fp"
    )


def _nibbles(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the sixteen 4-bit segments, packed in their own places."""
    x = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcounts: never above the number of differing bits."""
    eight, low = np.uint64(0x8888888888888888), np.uint64(0x0F0F0F0F0F0F0F0F)
    d = (a | eight) - b  # each nibble: 8 + difference
    total = np.zeros(len(a), np.uint64)
    for part in (d & low, (d >> np.uint64(4)) & low):
        for k in range(0, 64, 8):
            total += np.abs(((part >> np.uint64(k)) & np.uint64(15)).astype(np.int8) - np.int8(8)).astype(np.uint64)
    return total


def linked_pairs(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (sorted, standing rows first), as star edges."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((starts[1:], [len(key)]))
    stands = np.add.reduceat((probe == 0).astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.flatnonzero(probe == 1)
    width = stands[group[rows]]
    rows, width = rows[width > 0], width[width > 0]
    packed, out = _nibbles(fp), []
    at, done = 0, np.cumsum(width)
    while at < len(rows):
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + _PAIRS, side="right")))
        w = width[at:to]
        left = np.repeat(rows[at:to], w)
        right = np.repeat(starts[group[rows[at:to]]] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
        near = _manhattan(packed[left], packed[right]) <= bits
        left, right = left[near], right[near]
        true = (np.bitwise_count(fp[left] ^ fp[right]) <= bits) & (fp[left] != fp[right])
        if true.any():
            out.append(star_edges(fp[left[true]].view(np.int64), fp[right[true]].view(np.int64)))
        at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return star_edges(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            held = [c[last:] for c in cols]
            if last:
                a, b = linked_pairs(cols[0][:last], cols[1][:last], cols[2][:last].view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None and len(held[0]):
            a, b = linked_pairs(held[0], held[1], held[2].view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def cut_cells(rows: DataFrame, cell: list[str], node: str, tile_rows: int) -> DataFrame:
    """``rows`` with the ``key`` of their tiles, for cells in which rows of probe 1 ask those of probe 0.

    Cells with more rows than a tile are cut: standing rows by one hash, asking
    rows by another, and each tile gets one part of either.
    """
    sizes = rows.groupBy(*cell).agg(F.sum(F.when(F.col("probe") == 0, 1).otherwise(0)).alias("s"), F.sum("probe").alias("p"))
    cuts = checkpoint(
        sizes.where(f"s > {tile_rows} or p > 9 * {tile_rows}").select(
            *cell, *[F.greatest(F.lit(1), F.ceil(F.col(n) / tile_rows)).cast("long").alias(f"k{n}") for n in ("s", "p")]
        )
    )
    if large := cuts.count():
        cut = F.broadcast(cuts) if large <= BROADCAST_ROWS else cuts.hint("merge")
        stands = F.expr("transform(sequence(0L, kp - 1), x -> i * kp + x)")
        rows = (
            rows.join(cut, cell, "left").na.fill(1, ["ks", "kp"])
            .withColumn("i", F.pmod(F.xxhash64(F.lit(1), node), "ks")).withColumn("j", F.pmod(F.xxhash64(F.lit(2), node), "kp"))
            .withColumn("tile", F.explode(F.when(F.col("probe") == 0, stands).otherwise(F.expr("transform(sequence(0L, ks - 1), x -> x * kp + j)"))))
        )
    else:
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    return rows.withColumn("key", F.xxhash64(*cell, "tile"))


def links(classes: DataFrame, bits: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Star edges (a, b) that join all distinct fingerprints ``fp`` with up to ``bits`` (at most 3) differing bits.

    Cells with more rows than a tile are cut: standing rows by one hash, asking
    rows by another, and each tile gets one part of either. So a task holds two
    tiles of bounded size however many fingerprints share a cell, and a tile
    gives one edge per node, never all its pairs.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the halves' grid is exact for 0 to 3 differing bits")
    rows = _grid_rows(classes, segment_bits(classes.count()))
    tiled = cut_cells(rows, ["half", "cell"], "fp", tile_rows).select("key", "probe", "fp")
    prepare_workers(classes.sparkSession)
    ordered = tiled.repartition("key").sortWithinPartitions("key", "probe")
    return ordered.mapInArrow(_compare(bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents link when their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id that links reach, itself included.
    Equal fingerprints are one class from the start (a class is one row in the
    search, however many copies it has). Null texts count as empty and have the
    fingerprint zero, linked like any other; a null doc_id gets a row but never
    names a component; repeated rows give repeated rows; an empty table gives
    none. Other columns are not read.
    """
    marked = checkpoint(fingerprints(docs, doc_id, text, shingle))
    classes = checkpoint(marked.groupBy("fp").agg(F.min(doc_id).alias("first")))
    parts = connected_components(contracted(links(classes.select("fp"), bits)), "a", "b")
    joined = classes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = checkpoint(joined.groupBy("component").agg(F.min("first").alias("component_id")))
    named = checkpoint(joined.join(least, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group of near-duplicates.

    Rows of equal id are one document and one of them stays; rows without id
    stay, for no group can name them. All columns are unchanged.
    """
    found = near_duplicates(docs, doc_id, text, shingle, bits).select(F.col(doc_id).alias("_id"), "component_id")
    return keep_firsts(docs, found, doc_id)


def keep_firsts(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that (_id, component_id) rows name as their component, and those without id."""
    found = checkpoint(found)
    each = found.where("_id is not null").groupBy("_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("_id") == F.col("component_id")).alias("stays")
    )
    each = checkpoint(each.where("n > 1 or not stays"))  # most documents are neither repeated nor dropped
    drop, again = each.select("_id"), each.where("n > 1 and stays").select("_id")
    if each.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    out = docs.join(drop, docs[doc_id] == drop["_id"], "left_anti")
    if again.isEmpty():
        return out
    return out.union(docs.join(again, docs[doc_id] == again["_id"], "left_semi").dropDuplicates([doc_id]))
