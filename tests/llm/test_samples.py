import pytest
from pyspark.sql import functions as F

from stepmill.llm import permanent as p
from stepmill.llm import quota as q

ROWS = "id string, gold_idx int, split string, website string, load_no int, category string, u double"


def _rows(spark, n=2000):
    data = [(f"i{i}", i % 10 if i % 50 else None, "train" if i % 3 else "val", None if i % 7 == 0 else f"w{i % 5}", i % 4 + 1, "clash", 0.5) for i in range(n)]
    return spark.createDataFrame([*data, *data[:30], (None, 1, "val", "w1", 1, None, None)], ROWS)


def _targets(spark, rows):
    return spark.createDataFrame(rows, q.TARGETS)


def test_sample_meets_targets(spark):
    rows = _rows(spark)
    targets = _targets(spark, [("a", "split", "train", 30, 10, 5), ("a", "split", "val", 70, 10, 5), ("b", "website", "w1", 50, 20, 0), ("b", "website", "gone", 1, 20, 0), ("c", "gold_idx", "3", 1, 10, 9)])
    sample, report = q.draw(rows, targets)
    got = {(r.target_set, r.category): r.drawn for r in q.quota_report(sample, report).collect()}
    assert got["a", "train"] == 60 and got["a", "val"] == 140
    assert got["b", "w1"] == 200 and got["b", "gone"] == 0
    assert got["c", "3"] == 9
    sizes = {r.target_set: r["count"] for r in sample.groupBy("target_set").count().collect()}
    assert sizes["a"] == 200 and abs(sizes["b"] - 400) <= 5 and abs(sizes["c"] - 200) <= 2
    assert sample.groupBy("target_set", "id").count().where("count > 1").count() == 0
    assert {(r.target_set, r.category) for r in report.where("unmet").collect()} == {("b", "gone")}


def test_unmet_follows_the_rule(spark):
    rows = _rows(spark, 100)
    targets = _targets(spark, [("a", "split", "val", 35, 100, 0), ("a", "split", "train", 60, 100, 0), ("d", "split", "train", 1, 1, 67), ("e", "split", "train", 1, 1, 66), ("f", "nofield", "x", 1, 1, 0), ("g", "split", None, None, None, None)])
    _, report = q.plan(rows, targets)
    assert {r.target_set + ":" + str(r.category) for r in report.where("unmet").collect()} == {"a:val", "d:train", "f:x"}


def test_unreached_targets_are_those_the_sample_exhausts(spark):
    rows = _rows(spark, 100)
    targets = _targets(spark, [("a", "split", "val", 35, 100, 0), ("a", "split", "train", 60, 100, 0), ("d", "split", "train", 1, 1, 67), ("e", "split", "train", 1, 1, 66), ("f", "nofield", "x", 1, 1, 0), ("g", "split", None, None, None, None), ("h", "website", "w1", 10, 50, 3)])
    assert {(r.target_set, r.category) for r in q.unreached(rows, targets).collect()} == {("a", "val"), ("d", "train"), ("f", "x")}
    assert {r.target_set for r in q.unreached(rows.limit(0), targets).collect()} == {"d", "e", "h"}  # a share of nothing is met, a minimum is not


def test_sample_does_not_hang_on_partitions(spark):
    rows = _rows(spark, 600)
    targets = _targets(spark, [("a", "split", "train", 40, 30, 5), ("b", "website", "w2", 25, 40, 5)])
    one = {tuple(r) for r in q.draw(rows, targets)[0].collect()}
    assert one == {tuple(r) for r in q.draw(rows.repartition(9), targets)[0].collect()} and one


def test_floors_are_repaired(spark):
    rows = spark.createDataFrame([(f"i{i}", 1 if i < 4 else 2, "t", "w", 1, None, None) for i in range(400)], ROWS)
    sample, _ = q.draw(rows, _targets(spark, [("a", "gold_idx", "1", 1, 10, 10), ("a", "gold_idx", "2", 99, 10, 10)]))
    assert sample.where("category = '1'").count() == 4


def test_empty_quota(spark):
    none = _rows(spark, 0).limit(0)
    sample, report = q.draw(none, _targets(spark, [("a", "split", "x", 1, 1, 1)]))
    assert sample.count() == 0 and report.where("unmet").count() == 1
    sample, report = q.draw(_rows(spark, 20), _targets(spark, []))
    assert sample.count() == 0 and report.count() == 0


def test_permanent_sample_only_grows(spark):
    rows = _rows(spark, 800)
    ids = []
    for k in range(1, 5):
        ids.append({r.id for r in p.stable_sample(rows.where(F.col("load_no") <= k), 0.3).collect()})
    assert all(a <= b for a, b in zip(ids, ids[1:], strict=False))
    assert ids[-1] == {r.id for r in p.stable_sample(rows.repartition(11), 0.3).collect()}
    assert abs(len(ids[-1]) / 800 - 0.3) < 0.06
    last = p.sample_history(rows, 0.3).orderBy("load_no").collect()[-1]
    assert last.ids == 800 and last.chosen == len(ids[-1])


def test_store_keeps_numbers_and_refuses_to_shrink(spark, tmp_path):
    store = p.PermanentNumbers(spark, f"file://{tmp_path}/n")
    assert store.select(0.1).count() == 0
    ids = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "id string")
    store.insert(ids, 1)
    before = {r.id: r.u for r in store.numbers().collect()}
    store.insert(ids.union(spark.createDataFrame([("c",)], "id string")), 2)
    after = {r.id: (r.u, r.first_load) for r in store.numbers().collect()}
    assert set(after) == {"a", "b", "c"} and all(after[i] == (u, 1) for i, u in before.items())
    store.select(0.5)
    with pytest.raises(ValueError):
        store.select(0.4)


def test_empty_permanent(spark):
    assert p.stable_sample(_rows(spark, 0).limit(0)).count() == 0


def test_reopened_store_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/n"
    first = p.PermanentNumbers(spark, folder)
    first.insert(spark.createDataFrame([(f"i{i}",) for i in range(50)], "id string"), 1)
    before = {tuple(r) for r in first.numbers().collect()}
    chosen = {r.id for r in first.select(0.5).collect()}
    written = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "n" / "load=1-0").iterdir()}
    second = p.PermanentNumbers(spark, folder)
    with pytest.raises(ValueError):
        second.select(0.4)
    second.insert(spark.createDataFrame([("i3",), ("new",)], "id string"), 11)
    second.insert(spark.createDataFrame([("i4",)], "id string"), 1)
    after = {tuple(r) for r in second.numbers().collect()}
    assert before < after and {r[0] for r in after - before} == {"new"} and second.numbers().count() == 51
    assert chosen <= {r.id for r in second.select(0.5).collect()}
    assert written == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "n" / "load=1-0").iterdir()}


def test_unfinished_inserts_are_passed_over(spark, tmp_path):
    folder = f"file://{tmp_path}/n"
    p.PermanentNumbers(spark, folder).insert(spark.createDataFrame([("a",)], "id string"), 1)
    (tmp_path / "n" / "load=2-1").mkdir()
    (tmp_path / "n" / "load=2-1" / "part-0.parquet").write_bytes(b"torn")
    store = p.PermanentNumbers(spark, folder)
    store.insert(spark.createDataFrame([("a",), ("b",)], "id string"), 2)
    assert {(r.id, r.first_load) for r in store.numbers().collect()} == {("a", 1), ("b", 2)}


def test_samples_of_new_deliveries_alone_keep_the_old(spark, tmp_path):
    rows, folder = _rows(spark, 400), f"file://{tmp_path}/n"
    whole = {tuple(r) for r in p.stable_sample(rows, 0.3).collect()}
    old = {tuple(r) for r in p.stable_sample(rows.where("load_no < 4"), 0.3, folder=folder).collect()}
    both = {tuple(r) for r in p.stable_sample(rows.where("load_no = 4"), 0.3, folder=folder).collect()}
    assert old < both == whole
    assert {tuple(r) for r in p.sample_history(rows.where("load_no = 4"), 0.3, folder=folder).collect()} == {tuple(r) for r in p.sample_history(rows, 0.3).collect()}


def test_query_keeps_one_store_for_its_tables(spark, tmp_path):
    from stepmill.llm.queries import QUERIES

    rows, folder = _rows(spark, 200), f"{tmp_path}/tables"
    rows.where("load_no < 4").write.parquet(f"{folder}/eval_rows.parquet")
    old = {tuple(r) for r in QUERIES["p5_sample"](spark, folder).collect()}
    rows.where("load_no = 4").write.mode("overwrite").parquet(f"{folder}/eval_rows.parquet")
    assert old < {tuple(r) for r in QUERIES["p5_sample"](spark, folder + "/").collect()}
    assert sum(r.new_ids for r in QUERIES["p5_history"](spark, folder).collect()) == 200
