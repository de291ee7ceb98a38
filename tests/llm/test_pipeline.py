from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablemere.llm import secrets
from tablemere.llm.queries import TOKENIZER
from test_rules import measured
from test_shingles import slow_firsts

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(text):
    m = measured(text)
    n = m["n_words"]
    bad = n < 10 or 100 * m["n_repeat_words"] > 20 * n or 10 * m["n_symbols"] > 3 * n or 10 * m["n_bangs"] > 5 * n
    bad |= not 2 * n <= m["word_chars"] <= 20 * n or (m["n_dup_lines"] >= 3 and 10 * m["n_dup_lines"] > 5 * m["n_lines"])
    return not bad


def expected(rows):
    """Rows after rules, deduplication and redaction, by plain code."""
    rows = [r for r in rows if kept(r["text"])]
    first = slow_firsts([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]
    return [r | {"text": secrets.redacted(r["text"], secrets.all_spans(r["text"])[1])} for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DIR).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages(spark, stages):
    rows = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert list(stages) == ["quality_rules", "near_dedup", "secret_scan", "mixing_weights", "token_ids"]
    assert all(df.columns == COLUMNS for n, df in stages.items() if n != "token_ids")
    assert {r["doc_id"] for r in stages["quality_rules"].collect()} == {r["doc_id"] for r in rows if kept(r["text"])}
    want = {r["doc_id"]: r["text"] for r in expected(rows)}
    assert {r["doc_id"]: r["text"] for r in stages["secret_scan"].collect()} == want
    changed = {r["doc_id"]: r for r in rows if want.get(r["doc_id"], r["text"]) != r["text"]}
    for r in stages["secret_scan"].collect():
        assert r["n_chars"] == (len(r["text"]) if r["doc_id"] in changed else {x["doc_id"]: x for x in rows}[r["doc_id"]]["n_chars"])
    mixed = Counter(r["doc_id"] for r in stages["mixing_weights"].collect())
    assert set(mixed) == set(want)
    library = Tokenizer.from_file(TOKENIZER)
    last = stages["token_ids"].collect()
    assert Counter(r["doc_id"] for r in last) == mixed
    for r in last:
        assert r["ids"] == library.encode(want[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["intact"]


def test_run_gives_the_stages_rows(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DIR)) == key(stages["token_ids"])


def test_edges(spark, edge_docs, empty_docs):
    for docs, docs_had_rows in ((edge_docs, True), (empty_docs, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name != "token_ids":
                assert out.columns == docs.columns
            docs = out
        assert {r["doc_id"] for r in docs.collect()} == ({1, 9} if docs_had_rows else set())
