from tablemere.llm import mixing


def test_carried_rows_stand_in_the_permutation_s_order(spark, tmp_path):
    rows = [(i, f"s{i % 3 if i < 30 else 0}", "a b c d " * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    uses = mixing.mix(docs, budget=None).collect()
    want = [r["doc_id"] for r in sorted(uses, key=lambda r: (r["epoch"], r["block"], r["place"]))]
    assert len(want) > len(rows)
    mixing.mix(docs, budget=None, carry=True).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()] == want
