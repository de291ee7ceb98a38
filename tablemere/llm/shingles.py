"""Near-duplicates by the exact Jaccard similarity of word shingles.

First by SimHash and its popcount grid; then a prefix filter finds what lies
beyond the grid's bits. Candidates of either are compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablemere.llm import simhash
from tablemere.llm.common import Scratch, checkpoint, map_texts, prepare_workers, tidied
from tablemere.llm.components import connected_components, contracted, star_edges
from tablemere.llm.simhash import cut_cells, keep_firsts

#: Texts link from this part, of 100, of common shingles.
PERCENT = 80
#: Differing bits of the fingerprints that the popcount grid finds, the most that it can.
BITS = 3
#: One text of so many shows which shingles are common, but of few texts more: so many at least.
PART, SAMPLE = 8, 4000
#: In how many texts of the sample a common shingle is at least, and most of them that are noted (8 bytes for each level).
COMMON, MOST_COMMON = 2, 1 << 20
#: Texts of a candidate group, and bytes of their sets, that a task compares with one another or with as many others.
TILE_ROWS, TILE_BYTES = 2048, 16 << 20
#: Most candidate texts whose hashes, or classes with their groups, are broadcast (8 and 16 bytes each).
BROADCAST_ROWS = 200_000
#: Most classes under one key whose pairs are listed; more are compared in workers, so many standing rows of a cell at once.
LISTED, CELL_ROWS = 32, 2048
#: Pairs whose parities are compared at once in a worker, at the least width (256 bytes each); fewer of wider ones.
_PAIRS = 1 << 16
#: Keys that the prefixes of two sets share at least, where the similarity allows it: they are so much longer than for one.
SHARED = 3
#: Least and most bits of a set's parities, and bits of all parities of a task that compares sets.
_FEW_PARITIES, _MOST_PARITIES, _TASK_PARITIES = 1 << 10, 1 << 17, 1 << 28


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of a text's word shingles, each once; shorter texts are one shingle, no word gives none."""
    words = text.lower().split()  # words are those of simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    some = max(1, len(words) - shingle + 1)
    spans = zip(starts[:some].tolist(), (ends[-some:] - 1).tolist(), strict=True)
    return np.unique(np.fromiter([digest(joined[i:j], 42) for i, j in spans], np.uint64, some))


def width(n: int, most: int = _MOST_PARITIES) -> int:
    """Bits of the parities of a set of ``n`` shingles: a power of two, twice ``n`` up to ``most``, for fewer would tell no long sets apart."""
    return min(most, max(_FEW_PARITIES, 1 << (2 * n - 1).bit_length()))


def parities(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """A set's parities by place: two sets' differ in no more bits than the sets in shingles."""
    bits = bits or width(len(hashes))
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities as parities of ``words`` words, which divides theirs."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def stacked(bits: list[pa.Array]) -> np.ndarray:
    """Parities of any widths as rows of the narrowest one's."""
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in bits])
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in bits]).view(np.uint64)
    words, starts = int(sizes.min()), np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), words), np.uint64)
    for wide in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == wide)
        for lot in np.array_split(at, max(1, len(at) * wide >> 20)):
            out[lot] = folded(flat[starts[lot][:, None] + np.arange(wide)], words)
    return out


def _name(hashes: np.ndarray) -> int:
    """A set's own number: texts with equal sets are one class."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _shingles(docs: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """``keep`` columns, (sig long, sets binary): each text's class and its hashes."""

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        made = [shingle_set(raw[i:j], shingle) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        sig = np.array([_name(x) for x in made], np.uint64).view(np.int64)
        return {"sig": sig, "sets": pa.array([x.tobytes() for x in made], pa.binary())}

    return map_texts(docs, run, keep, text, "sig long, sets binary")


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Sorted hashes that several texts of a sample hold, each as often as its level. They only order shingles: results are the same for any.

    A level has twice the texts of the one before. The sample is a part of the
    different texts and grows with them, so that what is rare in it is in about
    so many texts of any table, not in a part of them.
    """

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        made = [shingle_set(raw[i:j], shingle).view(np.int64) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return {"h": pa.array(made, pa.list_(pa.int64()))}

    scratch, part = Scratch(docs.sparkSession), max(1, min(PART, docs.count() // SAMPLE))
    texts = docs.select(F.xxhash64(F.lit(17), text).alias("_place"), F.col(text).alias("_text"))
    sample = texts.where(F.pmod("_place", F.lit(part)) == 0).dropDuplicates(["_place"])  # copies are one class
    held = map_texts(sample, run, [], "_text", "h array<long>").select(F.explode("h").alias("h"))
    level = F.floor(F.log2(F.col("count") / COMMON) + 1e-9) + 1
    often = scratch.put("often", held.groupBy("h").count().where(f"count >= {COMMON}").select("h", level.cast("int").alias("level")))
    least, noted = 0, 0
    for r in often.groupBy("level").count().orderBy(F.desc("level")).collect():
        noted += r["count"]
        if noted > MOST_COMMON:
            least = r["level"]  # this level and those below are left out whole
            break
    found = often.where(F.col("level") > least).toArrow()
    scratch.drop("often")
    hashes, levels = (found.column(c).to_numpy() for c in ("h", "level"))
    return np.sort(np.repeat(hashes.view(np.uint64), levels - least))


def _shared(percent: int) -> int:
    """Keys that different sets of the similarity share: o of o + 1 shingles are no less than ``percent`` from some o on."""
    return max(1, min(SHARED, -(-percent // (100 - percent)))) if percent < 100 else 1


def prefix(hashes: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """So many hashes, common ones last by their levels, that two different sets of the similarity share ``_shared`` of them.

    Two such sets have ``percent`` of either in common; without all but so many
    of the last of these, so many are still common.
    """
    n = len(hashes)
    if len(common):
        at = np.searchsorted(common, hashes)
        late = common[np.minimum(at, len(common) - 1)] == hashes
        level = np.searchsorted(common, hashes[late], "right") - at[late]
        hashes = np.concatenate((hashes[~late], hashes[late][np.argsort(level, kind="stable")]))
    return hashes[: n - -(-percent * n // 100) + _shared(percent)]


def _prefixes(docs: DataFrame, doc_id: str, text: str, shingle: int, common: np.ndarray, percent: int) -> DataFrame:
    """(_id, place, sig, fp, n, bits, keys): each text's hash, class, fingerprint, number of shingles, parities and prefix."""

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        raw = data.tobytes()
        made = [shingle_set(raw[i:j], shingle) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return {
            "sig": np.array([_name(x) for x in made], np.uint64).view(np.int64),
            "fp": np.array([simhash.majority(x) for x in made], np.uint64).view(np.int64), "n": np.array([len(x) for x in made], np.int32),
            "bits": pa.array([parities(x).view(np.int64) for x in made], pa.list_(pa.int64())),
            "keys": pa.array([prefix(x, common, percent).view(np.int64) for x in made], pa.list_(pa.int64())),
        }

    marked = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("place"), F.col(text).alias("_text"))
    return map_texts(marked, run, ["_id", "place"], "_text", "sig long, fp long, n int, bits array<long>, keys array<long>")


def classes_of(marked: DataFrame) -> DataFrame:
    """One row of each class."""
    return marked.select("sig", "fp", "n", "bits", "keys").dropDuplicates(["sig"])


def alike(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join the classes whose fingerprints differ in up to BITS bits, as table ``alike``: op1's search.

    Equal fingerprints are one in the grid, however many classes have them.
    """
    prints = scratch.put("prints", classes.groupBy("fp").agg(F.min("sig").alias("head")))
    far = contracted(simhash.links(prints.select("fp"), BITS))
    for end in ("a", "b"):
        far = far.join(prints.select(F.col("fp").alias(end), F.col("head").alias(f"head{end}")), end)
    same = classes.select("fp", "sig").join(prints, "fp").where("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    edges = scratch.put("alike", same.union(far.select("heada", "headb")))
    scratch.drop("prints")
    return edges


def _near(apart, sizes, percent: int):
    """Whether sets whose parities differ in ``apart`` bits, of ``sizes`` shingles together, may have the similarity."""
    return apart * (100 + percent) <= sizes * (100 - percent)


def candidates(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) among the classes that share a key of their prefixes and aren't ruled out by parities or sizes, as table ``candidates``.

    Under a key with few classes all pairs are listed, and those that share
    enough such keys go on; ``_crowded`` compares those under a key with more,
    and gives no pairs but star edges. Links share ``_shared`` keys, so they are in
    one or the other, and the edges' components hold all of them.
    """
    rows = classes.select(F.explode("keys").alias("key"), "n", "sig")
    by_key = Window.partitionBy("key")
    ahead = by_key.orderBy("n", "sig").rowsBetween(1, LISTED - 1)
    shared = rows.withColumn("c", F.count(F.lit(1)).over(by_key)).where("c > 1")  # most keys are one class's
    crowd = F.col("c") > LISTED
    ahead_of = shared.select("key", "n", "sig", crowd.alias("crowd"), F.collect_list(F.struct("n", "sig")).over(ahead).alias("next"))
    fits = F.transform(F.filter("next", lambda x: F.col("n") * 100 >= x["n"] * percent), lambda x: x["sig"])
    met = ahead_of.select("key", "n", "sig", "crowd", F.when(~F.col("crowd"), fits).alias("others"))
    met = scratch.put("met", met.where("crowd or size(others) > 0"))  # all that needs the keys together, so that they are shuffled once
    pairs = met.where("not crowd").select("sig", F.explode("others").alias("other"))
    pairs = pairs.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"))
    # those that share fewer listed keys share a crowded one or are no link
    pairs = scratch.put("pairs", pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys")).where(f"keys >= {_shared(percent)}").select("a", "b"))
    known = classes.select("sig", "n", "bits")
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("sig").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")), end)
    prepare_workers(classes.sparkSession)
    near = pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(tidied(_compare_pairs(percent)), "a long, b long")
    crowded = met.where("crowd").select("key", "n", "sig")
    if not crowded.isEmpty():
        near = near.union(_crowded(crowded.join(known.select("sig", "bits"), "sig"), percent))
    edges = scratch.put("candidates", contracted(near))
    scratch.drop("met", "pairs")
    return edges


def _compare_pairs(percent: int):
    """Pairs (a, b) that their parities, at the narrower one's width, don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            a, b, na, nb = (np.asarray(batch.column(k)) for k in range(4))
            wide = [batch.column(k).value_lengths().to_numpy() for k in (4, 5)]
            by, stays = np.stack(wide, axis=1), np.zeros(len(a), bool)
            for kind in np.unique(by, axis=0):
                at = np.flatnonzero((by == kind).all(axis=1))
                for lot in np.array_split(at, max(1, len(at) * int(kind.max()) >> 20)):
                    x, y = (stacked([batch.column(k).take(pa.array(lot))]) for k in (4, 5))
                    words = min(x.shape[1], y.shape[1])
                    apart = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=1, dtype=np.int64)
                    stays[lot] = _near(apart, na[lot].astype(np.int64) + nb[lot], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[stays], pa.int64()), pa.array(b[stays], pa.int64())], ["a", "b"])

    return run


def _crowded(rows: DataFrame, percent: int, cell_rows: int | None = None) -> DataFrame:
    """Star edges (a, b) of the pairs under each key that parities and sizes don't rule out.

    Sets of the similarity have sizes in one class of the ratio or in the next:
    each row stands in its class and asks in that and the next. Large cells are
    cut into tiles, so a task holds two parts however many rows a key has.
    """
    step = F.floor(F.log(100.0 / percent, F.col("n").cast("double")) + 1e-9)
    places = F.array(
        F.struct(step.alias("step"), F.lit(0).alias("probe")), F.struct(step.alias("step"), F.lit(1).alias("probe")),
        F.struct((step + 1).alias("step"), F.lit(1).alias("probe")),
    )
    cells = rows.select(F.col("key").alias("shared"), "n", "sig", "bits", F.explode(places).alias("g")).select("shared", "n", "sig", "bits", "g.step", "g.probe")
    tiled = cut_cells(cells, ["shared", "step"], "sig", cell_rows or CELL_ROWS).select("key", "probe", "sig", "n", "bits")
    prepare_workers(rows.sparkSession)
    return tiled.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(tidied(_compare_crowds(percent)), "a long, b long")


def crowd_edges(probe: np.ndarray, sig: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among one tile's rows, standing ones first."""
    stands, out = int((probe == 0).sum()), []
    if not 0 < stands < len(probe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lot = max(1, _PAIRS * (_FEW_PARITIES // 64) // (stands * bits.shape[1]))
    for at in range(stands, len(probe), lot):
        ask = slice(at, min(len(probe), at + lot))
        apart = np.bitwise_count(bits[ask, None] ^ bits[None, :stands]).sum(axis=2, dtype=np.int64)
        size = n[ask, None].astype(np.int64), n[None, :stands].astype(np.int64)
        later = (size[0] < size[1]) | ((size[0] == size[1]) & (sig[ask, None] < sig[None, :stands]))
        i, j = np.nonzero(later & (size[0] * 100 >= size[1] * percent) & _near(apart, size[0] + size[1], percent))
        if len(i):
            out.append(star_edges(sig[ask][i], sig[:stands][j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return star_edges(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _compare_crowds(percent: int):
    """Over rows sorted by (key, probe): hold one tile's rows at a time."""

    def made(held: list[list]) -> pa.RecordBatch:
        *flat, bits = zip(*held, strict=True)
        probe, sig, n = map(np.concatenate, flat)
        a, b = crowd_edges(probe, sig, n, stacked(bits), percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key, probe, sig, n = (np.asarray(batch.column(k)) for k in range(4))
            bits = batch.column(4)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if i == j:
                    continue
                if held and key[i] != now:
                    yield made(held)
                    held = []
                now = key[i]
                held.append([probe[i:j], sig[i:j], n[i:j], bits.slice(i, j - i)])
        if held:
            yield made(held)

    return run


def linked_pairs(
    names: np.ndarray, labels: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that, with those that gave sets equal labels, join all sets of the similarity; with two parts only pairs across them are compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    wide = width(int(sizes.max()), max(_FEW_PARITIES, 1 << (_TASK_PARITIES // len(sets)).bit_length() - 1))
    bits = np.stack([parities(s, wide) for s in sets])
    _, first, of = np.unique(labels, return_index=True, return_inverse=True)
    across, root, out = parts.min() != parts.max(), first[of].tolist(), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        both = sizes[i] + sizes[rest]
        # sets of that similarity differ in so many shingles at most, and parities in no more
        near = np.minimum(sizes[i], sizes[rest]) * 100 >= np.maximum(sizes[i], sizes[rest]) * percent
        rest, both = rest[near], both[near]
        near = _near(np.bitwise_count(bits[i] ^ bits[rest]).sum(axis=1, dtype=np.int64), both, percent)
        if across:
            near &= parts[rest] != parts[i]
        for j in rest[near].tolist():
            x, y = find(i), find(j)
            if x == y:
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if same * 100 >= percent * (int(sizes[i] + sizes[j]) - same):
                root[max(x, y)] = min(x, y)
                out.append((i, j))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array(out).T
    return star_edges(names[a], names[b])


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        names, labels, parts = (table.column(c).to_numpy() for c in ("sig", "label", "part"))
        sets = [np.frombuffer(b, np.uint64) for b in table.column("sets").to_pylist()]
        a, b = linked_pairs(names, labels, parts, sets, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(grouped: DataFrame, percent: int = PERCENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Star edges (a, b) of all links among rows (component, sig, label, sets) of one component, but within a label.

    A component with more rows or bytes than a tile is cut into parts; each pair
    of parts is a tile, so a task holds two parts however large the component is.
    A set is sent once for each part of its component.
    """
    rows, size = F.count(F.lit(1)) / tile_rows, F.sum(F.length("sets")) / TILE_BYTES
    cuts = grouped.groupBy("component").agg(F.ceil(F.greatest(rows, size)).cast("long").alias("k"))
    tiled = (
        grouped.join(cuts, "component")
        .withColumn("part", F.pmod(F.xxhash64(F.lit(3), "sig"), "k"))
        .withColumn("q", F.explode(F.expr("sequence(0L, k - 1)")))
        .withColumn("tile", F.least("part", "q") * F.col("k") + F.greatest("part", "q"))
    )
    prepare_workers(grouped.sparkSession)
    # dealt by tile: the join's shuffle by component would do for the grouping, but leave all tiles of a component to one task
    dealt = tiled.select("component", "tile", "part", "sig", "label", "sets").repartition("component", "tile")
    return dealt.groupBy("component", "tile").applyInArrow(_compare(percent), "a long, b long")


def checked(
    docs: DataFrame, doc_id: str, text: str, shingle: int, ids: DataFrame, edges: DataFrame, known: DataFrame | None, percent: int, scratch: Scratch, name: str
) -> DataFrame:
    """Star edges (a, b), as table ``name``, of all links among the classes that candidate ``edges`` join, but those of ``known``.

    ``known`` has (node, component) of links found before: components whose
    classes these have joined already aren't compared again.
    """
    groups = checkpoint(connected_components(edges, "a", "b"))
    if known is None:
        groups = groups.withColumn("label", F.col("node"))
    else:
        groups = groups.join(known.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = groups.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        groups = checkpoint(groups.join(checkpoint(apart.select("component")), "component", "left_semi"))
    # one row of each class is named by text and id, so that its copies aren't read again
    one = F.min(F.struct("place", "_id")).alias("one")
    wanted = checkpoint(ids.join(groups, ids["sig"] == groups["node"], "left_semi").groupBy("sig").agg(one).select("one.place", "one._id"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64(text).alias("place"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    same = (texts["place"] == wanted["place"]) & texts["_id"].eqNullSafe(wanted["_id"])
    again = texts.join(wanted, same, "left_semi").select("place", "_text").dropDuplicates(["place"])
    few = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    sets = _shingles(again, ["place"], "_text", shingle).join(few, F.col("sig") == F.col("node")).select("component", "sig", "label", "sets")
    out = scratch.put(name, contracted(links(scratch.put("sets", sets), percent)))
    scratch.drop("sets")
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """(_id, component_id) for every document.

    Documents link when the Jaccard similarity of their sets of word shingles is
    ``percent`` of 100 or more; component_id is the smallest id that links
    reach, itself included. The popcount grid finds those whose fingerprints are
    alike; a prefix filter, which misses none, finds the rest; each candidate is
    compared by its whole set. Documents with equal sets are one class. Null
    texts count as empty and have the empty set, linked to its like only; a null
    id gets a row but never names a component.
    """
    scratch = Scratch(docs.sparkSession)
    common = common_shingles(docs, text, shingle)
    marked = scratch.put("prefixes", _prefixes(docs, doc_id, text, shingle, common, percent))
    ids = scratch.put("ids", marked.select("_id", "place", "sig"))
    classes = scratch.put("classes", classes_of(marked))
    scratch.drop("prefixes")
    near = checked(docs, doc_id, text, shingle, ids, alike(classes, scratch), None, percent, scratch, "near")
    rest = candidates(classes, percent, scratch)
    scratch.drop("classes")
    edges = checked(docs, doc_id, text, shingle, ids, rest, connected_components(near, "a", "b"), percent, scratch, "links").union(near)
    found = connected_components(edges, "a", "b")
    firsts = ids.groupBy("sig").agg(F.min("_id").alias("first"))
    joined = scratch.put(
        "joined", firsts.join(found, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("component", "sig").alias("component"))
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.put("named", joined.join(scratch.put("least", least), "component").select("sig", "component_id"))
    out = scratch.put("components", ids.join(named, "sig").select("_id", "component_id"))
    scratch.drop("ids", "alike", "near", "candidates", "links", "joined", "least", "named")
    return out


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id names their component, as ``simhash.one_of_each`` has them."""
    return keep_firsts(docs, near_duplicates(docs, doc_id, text, shingle, percent), doc_id)
