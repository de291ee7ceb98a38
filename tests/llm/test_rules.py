import re
from collections import Counter

import duckdb
import pytest

from tablemere.llm import rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_bangs": text.count("!"), "n_repeat_words": len(covered),
    }


TEXTS = [
    "", None, "a", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x x x x x x", " ".join(f"w{i}" for i in range(16)),
    "l1\nl1\nl1\n\nl2\nl2\n \n \n", "#1 *2* $3 %4% &5 |6| <7>", "hey! ho! " * 8, "ÄÖ\u00a0Ü 漢字 \U0001f600 z", "\n".join(["same line of five words"] * 6),
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(40)), "abcdefghijklmnopqrstuvwxyzabcdef " * 12,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_measures(docs):
    for r in rules.judge(docs).collect():
        want = measured(TEXTS[r["doc_id"]])
        assert {m: r[m] for m in rules.MEASURES} == want
        n = want["n_words"]
        base = n < 10 or 100 * want["n_repeat_words"] > 20 * n
        other = 10 * want["n_symbols"] > 3 * n or 10 * want["n_bangs"] > 5 * n or not 2 * n <= want["word_chars"] <= 20 * n
        other |= want["n_dup_lines"] >= 3 and 10 * want["n_dup_lines"] > 5 * want["n_lines"]
        assert r["base_failed"] == base and r["kept"] == (not base and not other)


def test_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(rules.ORACLE_SQL).df()
    mine = rules.judge(docs).toPandas()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert key(mine) == key(want)


def test_order_changes_no_verdict(docs):
    found = rules.estimate(docs)
    assert {e.rule for e in found} == set(rules.RULES) and all(0 <= e.rejected <= 1 and e.seconds > 0 for e in found)
    kept = sorted(r["doc_id"] for r in rules.keep(docs).collect())
    assert kept == sorted(r["doc_id"] for r in rules.judge(docs).where("kept").collect())
    assert kept == sorted(r["doc_id"] for r in rules.keep(docs, tuple(reversed(rules.RULES))).collect())
    assert kept == [7]


def test_the_order_is_by_rejection_per_second(docs):
    found = rules.estimate(docs)
    assert [e.rejected / e.seconds for e in found] == sorted((e.rejected / e.seconds for e in found), reverse=True)
    never = rules.Rule("never", ("n_words",), lambda n: n < 0)
    always = rules.Rule("always", ("n_words",), lambda n: n >= 0)
    assert [e.rule.name for e in rules.estimate(docs, (never, always))] == ["always", "never"]


def test_the_sample_is_not_the_first_rows(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id < 10000 THEN 'a' ELSE 'a b c d e f g h i j k l' END AS text")
    share = {e.rule.name: e.rejected for e in rules.estimate(df)}["few_words"]
    assert 0.3 < share < 0.7


def test_no_rules_keep_all(docs):
    assert rules.keep(docs, ()).count() == len(TEXTS)


def test_edges(edge_docs, empty_docs):
    kept = rules.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 1, 2, 9]
    judged = rules.judge(edge_docs)
    assert judged.count() == edge_docs.count() and judged.where("n_words = 60000 and kept").count() == 1
    assert rules.keep(empty_docs).count() == rules.judge(empty_docs).count() == 0


def test_plan_is_native(docs):
    plan = rules.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
