"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import let

#: Rows of the sample on which the order of rules is estimated; the order never changes a verdict.
SAMPLE_ROWS = 400
#: Timed runs of each rule on the sample, after one that compiles it; the least counts.
RUNS = 3
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_WINDOW = 5


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPACE)),
    )


def _windows(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - _WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(_WINDOW)]))


def _covered(starts: Column) -> Column:
    """Words under windows of five that start at these ascending places."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(_WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _repeat_words(text: Column, w: Column) -> Column:
    def places(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            found = F.filter(s, lambda e, k: same(e, k + 1) | F.when(k > 0, same(e, k - 1)).otherwise(F.lit(False)))
            return F.array_sort(F.transform(found, lambda e: e["i"]))

        return let(ordered, again)

    none = F.lit(0).cast("long")
    return F.when(F.size(w) <= _WINDOW, none).otherwise(
        let(
            _windows(w),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(places(h), _covered)),
        )
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")


#: What rules look at: name -> column of (text, its words).
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: F.regexp_count(F.coalesce(t, F.lit("")), F.lit("[#*$%&|<>]")).cast("long"),
    "n_lines": lambda t, w: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t, w: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_bangs": lambda t, w: F.regexp_count(F.coalesce(t, F.lit("")), F.lit("!")).cast("long"),
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``test`` of the measures it ``needs`` is true."""

    name: str
    needs: tuple[str, ...]
    test: Callable[..., Column]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("bangs", ("n_words", "n_bangs"), lambda n, b: 10 * b > 5 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 20 * n)),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda n, d: (d >= 3) & (10 * d > 5 * n)),
)


def _rejects(rule: Rule, text: Column, w: Column) -> Column:
    return rule.test(*[MEASURES[m](text, w) for m in rule.needs])


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Rejection share and seconds of each rule on a random sample of up to ``rows`` rows, best rejection per cost first."""
    texts, total = docs.select(F.col(text).alias("text")), docs.count()
    share = 1.2 * rows / max(1, total)
    sample = (texts.sample(share, seed=3) if share < 1 else texts).limit(rows).cache()
    try:
        total = max(1, sample.count())

        def timed(test: Column) -> tuple[float, float]:
            query, took = sample.select(F.count_if(let(words(F.col("text")), lambda w: test(w))).alias("n")), []
            hits = query.first()["n"]
            for _ in range(RUNS):
                began = time.perf_counter()
                query.collect()
                took.append(time.perf_counter() - began)
            return hits / total, min(took)

        least = timed(lambda w: F.size(w) < 0)[1]  # what all rules share
        found = []
        for rule in rules:
            share, took = timed(lambda w, rule=rule: _rejects(rule, F.col("text"), w))
            found.append(Estimate(rule, share, max(took - least, 1e-3)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda e: (-e.rejected / e.seconds, e.seconds))


def verdict(order: list[Rule], measures: dict[str, Column]) -> Column:
    """True unless a rule rejects; later rules are evaluated only where earlier ones pass."""
    out = None
    for rule in order:
        test = F.coalesce(rule.test(*[measures[m] for m in rule.needs]), F.lit(False))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged.

    Rules run cheapest rejection first, as estimated on a sample, and only what
    a rule needs is measured; of rules that tie the cheaper one is first. Null
    and empty texts have no word and so are rejected by ``few_words``; very long
    texts are measured whole; repeated rows get the same verdict; an empty table
    stays empty; other columns, whatever their names, pass through.
    """
    order = [e.rule for e in estimate(docs, rules, text)]
    t = F.col(text)
    return docs.where(let(words(t), lambda w: verdict(order, {m: f(t, w) for m, f in MEASURES.items()})))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, every measure, base_failed, kept) for each document.

    base_failed is the verdict of BASE_RULES alone; kept is that of the whole
    cascade, which holds them. Every measure is part of the result, so here the
    cascade decides on measures that are known; ``keep`` measures only what it
    comes to. Nulls, repeats and empty tables are as in ``keep``; a null doc_id
    keeps its row.
    """
    order = [e.rule for e in estimate(docs, rules, text)]
    t = F.col(text)
    measured = docs.select(
        doc_id, let(words(t), lambda w: F.struct(*[f(t, w).alias(m) for m, f in MEASURES.items()])).alias("m")
    )
    cols = {m: F.col(f"m.{m}") for m in MEASURES}
    return measured.select(
        doc_id, *[c.alias(m) for m, c in cols.items()],
        (~verdict(list(BASE_RULES), cols)).alias("base_failed"), verdict(order, cols).alias("kept"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM p),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(length(regexp_replace(s, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_bangs > 5 * n_words
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 5 * n_lines)) AS kept
FROM m
"""
