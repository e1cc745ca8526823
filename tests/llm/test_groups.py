import random

from stepmill.llm import groups as g

SCHEMA = "id string, website string, _annotation_id string, operation string, site string, grp string"


def _brute(rows):
    def key(w):
        if w is None:
            return None
        w = w.strip().lower()
        w = w[4:] if w.startswith("www.") else w
        return w.strip() or None

    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, w, t, *_ in rows:
        if key(w) is not None:
            find(("s", key(w)))
            if t is not None:
                up[find(("s", key(w)))] = find(("t", t))
    values = sorted({w for _, w, *_ in rows if key(w) is not None}, key=lambda w: w.encode())
    return {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if find(("s", key(a))) == find(("s", key(b)))}, find, key


def _random_rows(seed, n=300):
    rnd = random.Random(seed)
    sites = [f"site{i}" for i in range(60)]
    def write(s):
        return rnd.choice([s, s.upper(), f"www.{s}", f" {s} ", s, s])
    rows = []
    for i in range(n):
        site = rnd.choice([*sites, None, "", "  "]) if rnd.random() > 0.3 else "hot"
        rows.append((f"r{i}", write(site) if site and site.strip() else site, rnd.choice([None, *[f"t{j}" for j in range(180)]]), rnd.choice(["CLICK", "TYPE", None]), "clash", "clash"))
    return rows


def test_tied_sites_against_brute_force(spark):
    for seed in range(3):
        rows = _random_rows(seed)
        got = {(r.website_a, r.website_b) for r in g.tied_sites(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
        assert got == _brute(rows)[0]


def test_long_chain(spark):
    rows = [(f"r{i}-{k}", f"s{i + k:03d}", f"t{i}", "CLICK", None, None) for i in range(80) for k in (0, 1)]
    got = g.tied_sites(spark.createDataFrame(rows, SCHEMA)).count()
    assert got == 81 * 80 // 2


def test_assignment_keeps_groups_and_shares(spark):
    rows = _random_rows(9, 900)
    rows += rows[:20]
    shares = spark.createDataFrame([("train", 80), ("val", 10), ("test", 10)], "split string, share_pct int")
    records = g.record_groups(spark.createDataFrame(rows, SCHEMA)).cache()
    split = {r.id: r.split for r in records.join(g.assign_splits(records, shares), "grp").collect()}
    assert set(split) == {r[0] for r in rows}
    _, find, key = _brute(rows)
    seen = {}
    for i, w, t, *_ in rows:
        root = find(("s", key(w))) if key(w) is not None else find(("t", t)) if t is not None else ("r", i)
        assert seen.setdefault(root, split[i]) == split[i]
    again = {r.id: r.split for r in records.repartition(7).join(g.assign_splits(records.repartition(3), shares), "grp").collect()}
    assert again == split
    report = g.split_report(records, g.assign_splits(records, shares), shares).where("scope = 'all'").collect()
    assert sum(r.n for r in report) == 900


def test_many_small_groups_come_near_the_shares(spark):
    rows = [(f"r{i}", None, f"t{i // 2}", "CLICK" if i % 3 else "TYPE", None, None) for i in range(9000)]
    shares = spark.createDataFrame([("train", 80), ("val", 10), ("test", 10)], "split string, share_pct int")
    records = g.record_groups(spark.createDataFrame(rows, SCHEMA))
    report = {(r.scope, r.split, r.label): r.pct for r in g.split_report(records, g.assign_splits(records, shares), shares).collect()}
    assert abs(report["all", "train", None] - 80) < 0.5 and abs(report["label", "val", "TYPE"] - 10) < 1


def test_copies_of_an_id_tie_their_groups(spark):
    rows = [("a", "x", "t1", None, None, None), ("a", "y", "t2", None, None, None), ("b", "y", "t3", None, None, None), ("c", "z", "t4", None, None, None), ("c", None, None, None, None, None), ("d", None, "t5", None, None, None), ("d", None, "t6", None, None, None), ("e", None, "t6", None, None, None)]
    grp = {r.id: r.grp for r in g.record_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(grp) == set("abcde") and grp["a"] == grp["b"] and grp["d"] == grp["e"] and len(set(grp.values())) == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    shares = spark.createDataFrame([("train", 100)], "split string, share_pct int")
    assert g.tied_sites(none).count() == 0
    records = g.record_groups(none)
    assert g.assign_splits(records, shares).count() == 0


def test_small_groups_make_up_for_the_labels_of_the_large(spark):
    # one large group of nothing but clicks, then many small ones of either label
    rows = [(f"b{i}", "big", "CLICK") for i in range(3000)]
    rows += [(f"s{i}", f"g{i // 2}", "TYPE" if i // 2 % 2 else None) for i in range(4000)]
    rows += [(f"c{i}", f"h{i // 2}", "CLICK") for i in range(1000)]
    records = spark.createDataFrame(rows, "id string, grp string, label string")
    shares = spark.createDataFrame([("train", 75), ("val", 15), ("test", 10)], "split string, share_pct int")
    split = g.assign_splits(records, shares, large=1000)
    assert split.count() == split.select("grp").distinct().count() == 2501
    report = {(r.scope, r.split, r.label): r.pct for r in g.split_report(records, split, shares).collect()}
    for label in ("CLICK", "TYPE", None):
        for name, pct in (("train", 75), ("val", 15), ("test", 10)):
            assert abs(report["label", name, label] - pct) < 0.5, report
    assert abs(report["all", "val", None] - 15) < 0.5
