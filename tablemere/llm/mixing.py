"""Mixing sources to target weights by temperature, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablemere.llm.common import checkpoint, whole_row
from tablemere.llm.rules import words

#: Tokens of a block, until a source has BLOCKS of them; then its blocks grow instead.
BLOCK_TOKENS, BLOCKS = 1 << 16, 4096
#: Places of a block are cut by their upper bits into 4,096 parts, of which the window that ends an epoch sorts one.
PART_BITS = 52
#: Most sources whose totals come to the driver, or whose plan is broadcast (about 60 bytes each).
DRIVER_SOURCES = 100_000
#: Bisections, and the greatest exponent tried: sources below the largest then have next to no weight.
_STEPS, STEEPEST = 60, 64.0


@dataclass(frozen=True)
class Shape:
    """What an exponent makes of the shares."""

    entropy: float
    norm: float  # sum of (share / largest share) ** exponent
    least: float  # smallest weight / share: repetition at a budget of all tokens
    most: float


def _shape(totals: DataFrame, total: float, top: float, few: list[float] | None, exponent: float) -> Shape:
    if few is not None:
        powers = [(s / top) ** exponent for s in few]
        norm = math.fsum(powers)
        mass = [p / norm for p in powers]
        reps = [m / s for m, s in zip(mass, few, strict=True)]
        return Shape(-math.fsum(m * math.log(m) for m in mass if m), norm, min(reps), max(reps))
    share = F.col("tokens") / F.lit(total)
    power = F.pow(share / F.lit(top), F.lit(exponent))
    row = totals.where("tokens > 0").agg(
        F.sum(power).alias("z"), F.sum(F.when(power > 0, power * F.log(power)).otherwise(0.0)).alias("l"),
        F.min(power / share).alias("lo"), F.max(power / share).alias("hi"),
    ).first()
    return Shape(math.log(row["z"]) - row["l"] / row["z"], row["z"], row["lo"] / row["z"], row["hi"] / row["z"])


def _bisect(holds, lo: float, hi: float) -> float:
    """The place nearest to ``hi`` on the way from ``lo`` where ``holds``, which is true up to there; ``lo`` if nowhere."""
    if holds(hi):
        return hi
    for _ in range(_STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo


def exponent_for(shape, sources: int, entropy: float, repeat_limit: float, budget: float | None) -> float:
    """Exponent at which the weights have the entropy, moved towards 1 until no source exceeds the repetition limit.

    Entropy falls as the exponent rises: below 1 it flattens the shares, above 1
    it sharpens them, so a target on either side of the shares' own entropy is
    met. Where even STEEPEST has more (sources tied for the largest), that is
    taken. ``budget`` is a multiple of all tokens, or None for the least with
    which every source is used whole at least once.
    """
    if sources < 2:
        return 1.0
    enough = lambda a: shape(a).entropy >= entropy * math.log(sources) - 1e-12
    steep = 1.0
    while steep < STEEPEST and enough(steep):
        steep *= 2
    wanted = _bisect(enough, 0.0, steep)

    def most(a: float) -> float:
        s = shape(a)
        return s.most * budget if budget is not None else s.most / s.least if s.least else math.inf

    if most(1.0) > repeat_limit:
        return 1.0
    return _bisect(lambda a: most(a) <= repeat_limit, 1.0, wanted)


def _key(source: Column) -> Column:
    """Sources as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _place(doc_id: Column, tokens: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id.cast("string"), tokens)


def source_plan(totals: DataFrame, entropy: float = 0.95, repeat_limit: float = 4.0, budget: float | None = 1.0) -> DataFrame:
    """(key, tokens, weight, whole epochs, rest tokens of one more) from (key, tokens) totals per source."""
    head = totals.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("n")).first()
    total, sources = head["t"] or 0, head["n"]
    if not sources:
        return totals.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("whole"), F.lit(0).cast("long").alias("rest"))
    few, top = None, totals.agg(F.max("tokens")).first()[0] / total
    if sources <= DRIVER_SOURCES:
        few = sorted(r["tokens"] / total for r in totals.where("tokens > 0").select("tokens").collect())
    shape = lambda a: _shape(totals, float(total), top, few, a)
    exponent = exponent_for(shape, sources, entropy, repeat_limit, budget)
    made = shape(exponent)
    size = 1.0 / made.least if budget is None else budget
    share = F.col("tokens") / F.lit(float(total))
    weight = F.when(F.col("tokens") > 0, F.pow(share / F.lit(top), F.lit(exponent)) / F.lit(made.norm)).otherwise(0.0)
    reps = F.when(F.col("tokens") > 0, weight / share * F.lit(size)).otherwise(1.0)
    whole = F.floor(reps + 1e-9)
    rest = F.round(F.greatest(reps - whole, F.lit(0.0)) * F.col("tokens")).cast("long")
    return totals.select("key", "tokens", weight.alias("weight"), whole.cast("long").alias("whole"), rest.alias("rest"))


def _end(rows: DataFrame, wanted: str, unit: str) -> DataFrame:
    """(key, unit, left): of each key the unit, in their order, in which ``wanted`` tokens are reached, and those wanted of it.

    Units are few for a key, and are summed before the window looks at them.
    """
    sizes = rows.groupBy("key", wanted, unit).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy(unit)) - F.col("n")
    return sizes.withColumn("left", F.col(wanted) - before).where("`left` > 0 and `left` <= n").select("key", unit, "left")


def mix(
    docs: DataFrame, entropy: float = 0.95, repeat_limit: float = 4.0, budget: float | None = 1.0, seed: int = 11,
    doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False,
) -> DataFrame:
    """Rows (doc_id, source, n_tokens, weight, epoch, block, place), one for each use of a document.

    Tokens are words. A source's weight is its token share to the power of an
    exponent, normalised: the exponent is bisected so that the weights have
    ``entropy`` (as a part of the greatest possible), unless a source would
    then be used more than ``repeat_limit`` times. ``budget`` is the output's
    tokens as a multiple of the input's; None takes the least with which every
    document is used at least once. A source's tokens are realised as whole
    epochs and then one more that ends in the block where the budget is met, and
    in that block at the document that meets it. Each epoch is a permutation:
    read rows by (epoch, block, place).

    With ``carry`` the columns are those of ``docs`` instead, and rows are
    dealt and sorted in that order, so that a table written of them is the
    permutation. Null sources are
    one source; null and empty texts have no token and, like sources without
    tokens, are used with each whole epoch; a very long text is one document and
    may exceed its source's budget by its length; documents with equal id and
    length stand at one place, in no order, and go in or out of the budget
    together; an empty table gives none.
    """
    whole = whole_row(docs) if carry else F.struct(F.col(doc_id), F.col(source))
    rows = docs.select(
        whole.alias("d"), F.col(doc_id).alias("id"), _key(F.col(source)).alias("key"),
        F.size(words(F.col(text))).cast("long").alias("n"),
    )
    light = checkpoint(rows.select("id", "key", "n"))
    totals = checkpoint(light.groupBy("key").agg(F.sum("n").alias("tokens")))
    plan = checkpoint(
        source_plan(totals, entropy, repeat_limit, budget).withColumn(
            "blocks", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long")
        )
    )
    few = plan.count() <= DRIVER_SOURCES
    small = lambda df: F.broadcast(df) if few else df.hint("merge")
    last = light.join(small(plan.where("rest > 0").select("key", "whole", "rest", "blocks")), "key")
    last = last.withColumn("place", _place(F.col("id"), F.col("n"), F.col("whole"), seed)).withColumn(
        "block", F.pmod("place", "blocks")
    )
    ends = checkpoint(_end(last, "rest", "block").withColumnRenamed("block", "last_block"))
    # the document that meets the budget, in the one block per source that does, and there in one part of the hashes
    edge = last.drop("rest").join(small(ends), "key").where("block = last_block").withColumn("part", F.shiftright("place", PART_BITS))
    parts = checkpoint(_end(edge, "left", "part").select("key", F.col("part").alias("last_part"), F.col("left").alias("more")))
    edge = edge.join(small(parts), "key").where("part = last_part")
    run = F.sum("n").over(Window.partitionBy("key").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    cut = edge.withColumn("run", run).where("run >= more").groupBy("key").agg(F.min("place").alias("last_place"))
    cut = checkpoint(cut)
    full = plan.join(ends.select("key", "last_block"), "key", "left").join(cut, "key", "left")
    out = rows.join(small(checkpoint(full)), "key").withColumn("epoch", F.explode(F.expr("sequence(0L, whole)")))
    out = out.withColumn("place", _place(F.col("id"), F.col("n"), F.col("epoch"), seed)).withColumn(
        "block", F.pmod("place", "blocks")
    )
    used = (F.col("epoch") < F.col("whole")) | (F.col("block") < F.col("last_block")) | (
        (F.col("block") == F.col("last_block")) & (F.col("place") <= F.col("last_place"))
    )
    out = out.where(used)
    if carry:
        order = ["epoch", "block", "place"]
        return out.select("d", *order).repartitionByRange(*order).sortWithinPartitions(*order).select("d.*")
    return out.select(
        F.col("d").getField(doc_id).alias("doc_id"), F.col("d").getField(source).alias("source"), F.col("n").alias("n_tokens"),
        "weight", F.col("epoch").cast("int").alias("epoch"), "block", "place",
    )
