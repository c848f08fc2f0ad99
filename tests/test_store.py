import pytest
from pyspark.sql import functions as F

from plumbline.operators.keyed_store import KeyedStore
from plumbline.session import new_folder


def store(spark, **kw):
    return KeyedStore(spark, new_folder(spark, "test-store"), **kw)


def rows(spark, data):
    return spark.createDataFrame(data, "id string, at int, k string, extra array<string>")


def test_equal_ids_collapse_over_batches_and_upsert_is_idempotent(spark):
    s = store(spark, n_buckets=3)
    a = rows(spark, [("1", 1, "a", []), ("1", 2, "b", ["x"]), ("2", 1, "c", None), (None, 1, "n", [])])
    b = rows(spark, [("1", 3, "d", []), ("3", None, "e", []), (None, 1, "n", [])])
    assert s.upsert(a, F.col("id"), "a", [F.col("at")])
    assert s.upsert(b, F.col("id"), "b", [F.col("at")])
    assert not s.upsert(a, F.col("id"), "a", [F.col("at")])
    got = {r["id"]: (r["k"], r["n"]) for r in s.read("n").collect()}
    assert got == {"1": ("d", 3), "2": ("c", 1), "3": ("e", 1)}
    assert s.unkeyed().count() == 2
    again = KeyedStore(spark, s.path)
    assert not again.upsert(b, F.col("id"), "b", [F.col("at")])
    assert again.read().count() == 3


def test_result_does_not_depend_on_batching(spark):
    data = [(str(i % 7), i % 5, f"v{i}", [str(i)]) for i in range(60)]
    one, many = store(spark, n_buckets=2), store(spark, n_buckets=2)
    one.upsert(rows(spark, data), F.col("id"), "all", [F.col("at")])
    for j in range(5):
        many.upsert(rows(spark, data[j::5]), F.col("id"), str(j), [F.col("at")])
    assert sorted(map(str, one.read("n").collect())) == sorted(map(str, many.read("n").collect()))


def test_merge_of_runs_neither_shuffles_nor_sorts(spark):
    from plumbline.operators.keyed_store import ORDERED_SCAN

    s = store(spark, n_buckets=2)
    for b in "abc":
        s.upsert(rows(spark, [("1", 1, b, []), ("2", 1, b, [])]), F.col("id"), b)
    assert len(s.runs) == 2
    assert spark.conf.get(ORDERED_SCAN) == "false", "options are put back"
    spark.conf.set(ORDERED_SCAN, "true")
    try:
        plan = s.merge_plan()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(ORDERED_SCAN, "false")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    view = s.read("times")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in view and "Exchange" not in view, "runs are brought together bucket by bucket"


def test_a_batch_rewrites_its_level_only(spark):
    s = store(spark, n_buckets=2)
    for i in range(7):
        s.upsert(rows(spark, [(str(j), i, f"v{i}", []) for j in range(i, i + 3)]), F.col("id"), str(i), [F.col("at")])
        assert len(s.runs) == bin(i + 1).count("1")
    oldest = s.runs[0]
    s.upsert(rows(spark, []), F.col("id"), "x")
    rows_out = s.read("n").collect()
    got = {r["id"]: (r["k"], r["n"]) for r in rows_out}
    assert len(rows_out) == 9 and got == {str(j): (f"v{min(j, 6)}", min(j, 6) - max(0, j - 2) + 1) for j in range(9)}
    assert len(s.runs) == 1 and s.runs[0] != oldest
    s.upsert(rows(spark, [("0", 9, "new", [])]), F.col("id"), "y", [F.col("at")])
    top = s.runs[0]
    s.upsert(rows(spark, [("1", 9, "new", [])]), F.col("id"), "z", [F.col("at")])
    assert s.runs[0] == top, "the old rows stay where they are"
    again = KeyedStore(spark, s.path)
    out = again.read().collect()
    assert len(out) == 9 and {r["id"]: r["k"] for r in out}["0"] == "new"
    again.compact()
    assert len(again.runs) == 1 and again.deliveries().agg(F.sum("n")).first()[0] == 23


def test_empty_batches_and_empty_store(spark):
    s = store(spark, n_buckets=2)
    with pytest.raises(ValueError):
        s.read()
    s.upsert(rows(spark, []), F.col("id"), "none")
    assert s.read().count() == 0 and s.deliveries().count() == 0


def test_ties_very_long_values_and_clashing_names(spark):
    s = store(spark, n_buckets=2)
    df = spark.createDataFrame([("a" * 100_000, 1, 2, 3)] * 3 + [("b", None, None, None)], "k string, v int, n int, rank int")
    s.upsert(df, F.col("k"), "x", [F.col("v")])
    got = s.read("times").collect()
    assert sorted((len(r["k"]), r["times"], r["n"]) for r in got) == [(1, 1, None), (100_000, 3, 2)]


def test_whole_envelopes_come_out_of_the_deliveries(spark, tmp_path):
    from plumbline.plans import delivery

    source = spark.read.parquet(f"/root/testdata/sf0.001/{delivery.RECORDS}.parquet")
    keyed = source.filter("collection.adzuna_id is not null").limit(40)
    loose = keyed.limit(3).withColumn("collection", F.col("collection").withField("adzuna_id", F.lit(None).cast("string")))
    later = keyed.limit(5).withColumn("collection", F.col("collection").withField("collected_at", F.lit("2030-01-01T00:00:00Z")))
    keyed.union(loose).union(loose).union(later).write.parquet(f"{tmp_path}/{delivery.RECORDS}.parquet")
    rows = spark.read.parquet(f"{tmp_path}/{delivery.RECORDS}.parquet").collect()
    out = delivery.p1_envelopes(spark, str(tmp_path))
    assert out.columns == [*source.columns, "deliveries"]
    got = [((r["collection"], r["raw"]), r["deliveries"]) for r in out.collect()]
    want = {}
    for r in rows:
        if r["collection"]["adzuna_id"] is not None:
            want.setdefault(r["collection"]["adzuna_id"], []).append((r["collection"], r["raw"]))
    one = {e[0]["adzuna_id"]: (e, n) for e, n in got if e[0]["adzuna_id"] is not None}
    assert one.keys() == want.keys() and len(one) + 6 == len(got)
    for k, (e, n) in one.items():
        assert e in want[k] and n == len(want[k])
        if any(x[0]["collected_at"].startswith("2030") for x in want[k]):
            assert e[0]["collected_at"].startswith("2030")
    free = sorted(str(e) for e, n in got if e[0]["adzuna_id"] is None)
    assert free == sorted(str((r["collection"], r["raw"])) for r in rows if r["collection"]["adzuna_id"] is None)
