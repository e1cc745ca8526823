import itertools
import random

from stepmill.llm import packing as k

WINDOWS = "window_name string, capacity_tokens int, size int"


def test_best_fit_is_valid():
    rnd = random.Random(1)
    for _ in range(50):
        cap = rnd.randint(5, 100)
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 200))]
        bins, room = k.best_fit(sizes, cap)
        fill = [0] * len(room)
        for s, b in zip(sizes, bins, strict=True):
            fill[b] += s
        assert [cap - f for f in fill] == room and all(r >= 0 for r in room)
        assert k.lower_bound(sizes, cap) <= len(room)


def _least(sizes, cap):
    best = len(sizes)
    for split in itertools.product(range(len(sizes)), repeat=len(sizes)):
        used = {}
        for s, b in zip(sizes, split, strict=True):
            used[b] = used.get(b, 0) + s
        if max(used.values()) <= cap:
            best = min(best, len(used))
    return best


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(3)
    for _ in range(25):
        cap = rnd.randint(6, 20)
        sizes = [rnd.randint(1, cap) for _ in range(5)]
        assert k.lower_bound(sizes, cap) <= _least(sizes, cap)
    assert k.lower_bound([6] * 5, 10) == 5 and k.lower_bound([], 10) == 0


def test_packing_places_every_token_once(spark):
    rnd = random.Random(7)
    sizes = [(i, rnd.choice([0, 3, 17, 64, 99, 100, 101, 260])) for i in range(900)]
    table = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int")
    windows = spark.createDataFrame([("w", 100, 1), ("x", 64, 1), ("bad", None, 1)], WINDOWS)
    packed = k.pack(k.pieces(table, windows), per_partition=150).toPandas()
    for name, cap in (("w", 100), ("x", 64)):
        mine = packed[packed.window_name == name]
        assert mine.groupby("container")["size"].sum().max() <= cap
        got = mine.groupby("doc_id")["size"].sum().to_dict()
        assert got == {i: n for i, n in sizes if n}
        cut = mine[mine.duplicated("doc_id", keep=False)].doc_id.unique()
        assert set(cut) == {i for i, n in sizes if n > cap}
        assert not mine.duplicated(["doc_id", "start_token"]).any()
        # the bound holds for all items together; partitions may lose a little on it
        assert k.lower_bound(mine["size"].tolist(), cap) <= mine.container.nunique() <= k.lower_bound(mine["size"].tolist(), cap) * 1.03 + 2
    report = k.packing_report(k.pack(k.pieces(table, windows)), windows).collect()
    assert all(r.containers >= r.bound for r in report) and len(report) == 2


def test_counts_are_those_of_the_tokenizer(spark):
    texts = [(1, "Hello wörld"), (2, None), (3, ""), (4, "ab " * 40_000), (None, "x"), (1, "Hello wörld")]
    got = {(r.doc_id, r.n_tokens) for r in k.token_counts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    enc = k.load_tokenizer()
    assert got == {(i, len(enc.encode_ordinary(t)) if t else 0) for i, t in texts}
    assert enc.decode(enc.encode_ordinary("Grüße 你好")) == "Grüße 你好"


def test_empty_packing(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens int")
    windows = spark.createDataFrame([("w", 10, 1)], WINDOWS)
    assert k.pack(k.pieces(none, windows)).count() == 0


def test_bound_tries_every_size():
    def every(sizes, cap):
        return max(-(-sum(cap if x > cap - e else 0 if x < e else x for x in sizes) // cap) for e in range(cap // 2 + 1))

    rnd = random.Random(5)
    for _ in range(60):
        cap = rnd.randint(200, 2000)
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 400))]
        assert k.lower_bound(sizes, cap) >= every(sizes, cap)
    # 301 sizes up to half the capacity: e = 303 lies between those that a stride would try
    sizes = [698] * 100 + [303] * 100 + list(range(1, 201)) + list(range(304, 404))
    assert k.lower_bound(sizes, 1000) >= every(sizes, 1000) > -(-sum(sizes) // 1000)


def test_report_has_the_bound_of_the_sizes(spark):
    table = spark.createDataFrame([(i, 60) for i in range(50)] + [(i, 250) for i in range(50, 60)], "doc_id bigint, n_tokens int")
    windows = spark.createDataFrame([("w", 100, 1), ("none", None, 1)], WINDOWS)
    row = k.packing_report(k.pack(k.pieces(table, windows)), windows).collect()
    assert [(r.window_name, r.tokens, r.containers, r.bound) for r in row] == [("w", 5500, 75, 75)]


def test_rounds_go_on_until_nothing_is_saved(spark):
    rnd = random.Random(9)
    sizes = spark.createDataFrame([(i, rnd.choice([rnd.randint(1, 120), 55, 56, 67])) for i in range(3000)], "doc_id bigint, n_tokens int")
    windows = spark.createDataFrame([("w", 100, 1), ("same", 54, 1)], WINDOWS)
    packed = k.pack(k.pieces(sizes, windows), per_partition=40).cache()
    assert [tuple(r)[1:] for r in k.faults(packed, sizes, windows).orderBy("window_name").collect()] == [(3000, 0, 0, 0, 0)] * 2
    for name, cap in (("w", 100), ("same", 54)):
        mine = [r["size"] for r in packed.where(k.F.col("window_name") == name).collect()]
        assert k.lower_bound(mine, cap) <= packed.where(k.F.col("window_name") == name).select("container").distinct().count() <= len(k.best_fit(mine, cap)[1]) * 1.02 + 1


def test_faults_are_seen(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 150), (3, 80)], "doc_id bigint, n_tokens int")
    windows = spark.createDataFrame([("w", 100, 1)], WINDOWS)
    bad = spark.createDataFrame(
        [("w", 1, 0, 0, 30, "a", 0, True), ("w", 3, 0, 0, 80, "a", 0, True), ("w", 2, 0, 0, 75, "b", 25, True), ("w", 2, 1, 74, 75, "c", 24, True)],
        "window_name string, doc_id bigint, piece int, start_token int, size int, container string, room int, certified boolean",
    )
    assert [tuple(r) for r in k.faults(bad, sizes, windows).collect()] == [("w", 3, 1, 1, 0, 2)]
