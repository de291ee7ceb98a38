import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablemere.llm import common


def test_bounded_sample_is_the_least_hashes(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k")
    place = F.xxhash64(F.lit(17), "id")
    for rows in (0, 1, 40, 600, 2000, 9000):
        got = sorted(r["id"] for r in common.bounded_sample(df, "id", rows).collect())
        assert got == sorted(r["id"] for r in df.orderBy(place).limit(rows).collect())
    assert common.bounded_sample(df, "k", 100).count() == 100
    assert common.bounded_sample(df.limit(0), "id", 10).count() == 0


def test_slices_keep_all_rows_whole():
    texts = ["a" * n for n in (0, 3, 50, 0, 7, 7, 200, 1)] + [None, "é" * 9]
    batch = pa.RecordBatch.from_pydict({"k": list(range(10)), "t": pa.array(texts, pa.string())})
    for limit in (1, 10, 64, 10_000):
        parts = list(common.slices(iter([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)]), "t", limit))
        assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(10))
        for p in parts:
            data, offs = common.text_buffer(p.column(1))
            raw = data.tobytes()
            assert [raw[i:j].decode() for i, j in zip(offs[:-1], offs[1:], strict=True)] == [t or "" for t in p.column(1).to_pylist()]
            assert len(raw) <= limit or p.num_rows == 1 or len(raw) - np.diff(offs).max() <= limit


def test_crc(spark):
    import zlib

    df = spark.createDataFrame([(1,), (-5,), (123456789,), (None,)], "doc_id long").select("doc_id", common.crc_mod("doc_id", 5).alias("m"))
    assert all(r["m"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 for r in df.collect())


def test_a_worker_holds_one_state_and_drops_it_for_tasks_without():
    first = common.worker_state("a", lambda: ["a"])
    assert common.worker_state("a", lambda: ["b"]) is first
    common.worker_state("b", lambda: ["b"])
    assert list(common._state) == ["b"]
    assert list(common.tidied(iter, state=True)([1, 2])) == [1, 2]
    assert list(common._state) == ["b"]
    assert list(common.tidied(iter)([1, 2])) == [1, 2]
    assert not common._state


def test_workers_drop_their_state(spark):
    def held(data, offs):
        common.worker_state("mine", lambda: [1])
        return {"n": np.array([len(common._state)] * (len(offs) - 1))}

    def none(data, offs):
        return {"n": np.array([len(common._state)] * (len(offs) - 1))}

    df = spark.range(8).selectExpr("cast(id AS string) AS t").coalesce(1)
    got = [{r["n"] for r in common.map_texts(df, fn, [], "t", "n long", state=s).collect()} for fn, s in ((held, True), (none, True), (none, False))]
    assert got == [{1}, {1}, {0}]
