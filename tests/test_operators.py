import pytest
from pyspark.sql import functions as F

from stepmill.functions.schema import ATTRS, EVAL_ROW, RANK, TASK
from stepmill.operators import predict, records, sampling, sanity, scoring, steps, traces
from stepmill.sources import files

NODES = "step_key string, backend_node_id string, pos int, tag string, role string, text string, attrs struct<" + ", ".join(f"`{a}`: string" for a in ATTRS) + ">"


def _task(uid, pos, n_neg, missing=()):
    return ("t", "w", "d", "goal", [f"r{i}" for i in range(8)], [(f"a{k}", "<p>", ("CLICK", "") if k else ("TYPE", "v"), pos, [(f"n{i}", None) for i in range(n_neg)]) for k in range(7)])


def _nodes(spark, tasks, missing):
    rows = []
    for t in tasks:
        for a in t[5]:
            for p, (node, *_) in enumerate([*(a[3] or []), *(a[4] or [])]):
                if node not in missing:
                    rows.append((f"{t[0]}_{a[0]}", node, p, "a", None, f"text {node}", None))
    return spark.createDataFrame(rows, NODES)


def test_history_positions(spark):
    got = spark.range(8).select(steps.history_slice(F.array(*[F.lit(f"r{i}") for i in range(8)]), F.col("id").cast("int")).alias("h")).collect()
    assert [r.h for r in got] == [[f"r{i}" for i in range(max(0, k - 5), k)] for k in range(8)]


def test_rows_are_built(spark):
    tasks = [_task("t", [("g0", False), ("g1", True)], 30)]
    s = steps.explode_steps(spark.createDataFrame(tasks, TASK))
    ranks = spark.createDataFrame([("t_a0", f"n{i}", 100 - i) for i in range(12)], RANK)
    rows, skipped = steps.build_rows(s, ranks, _nodes(spark, tasks, {"n11", "n5"}), augment=True)
    out = {r.id: r for r in rows.collect()}
    assert len(out) == 14 and set(out) == {f"t_a{k}{e}" for k in range(7) for e in ("", "_aug")}
    r = out["t_a0"]
    assert r.candidates[r.gold_idx].text == "text g1" and [c.idx for c in r.candidates] == list(range(10)) and r.operation == "TYPE" and r.value == "v"
    assert out["t_a1"].value is None and out["t_a6"].previous_actions == ["r1", "r2", "r3", "r4", "r5"]
    negs = {c.text for c in r.candidates} - {"text g1"}
    assert {f"text n{i}" for i in (10, 9, 8, 7, 6, 4, 3)} <= negs and "text n11" not in negs and len(negs) == 9
    assert {x.skip_reason for x in skipped.collect()} == {None}
    again = {q.id: q for q in steps.build_rows(s.repartition(5), ranks, _nodes(spark, tasks, {"n11", "n5"}), augment=True)[0].collect()}
    assert again == out


def test_skip_reasons(spark):
    def reasons(pos, n, missing):
        tasks = [_task("t", pos, n)]
        s = steps.explode_steps(spark.createDataFrame(tasks, TASK))
        return {r.skip_reason for r in steps.build_rows(s, spark.createDataFrame([], RANK), _nodes(spark, tasks, missing))[1].collect()}

    gold = [("g", None)]
    assert reasons([], 12, ()) == {"skip_no_pos"} and reasons(gold, 8, ()) == {"skip_insufficient_neg"} and reasons(gold, 9, {"g"}) == {"skip_gold_not_found"}
    assert reasons(gold, 9, {"n1"}) == {"skip_neg_not_found"} and reasons(gold, 9, ()) == {None} and reasons(gold, 10, {"n1"}) == {None}


def test_ranked_negatives_and_ties(spark):
    data = [("s", f"n{i}", i, r) for i, r in enumerate([5, 5, None, 1, 0])] + [("q", f"n{i}", i, None) for i in range(4)]
    df = spark.createDataFrame(data, "step string, node string, pos int, rank bigint")
    got = {(r.step, r.node): r.rn for r in steps.ranked_negatives(df, "step", "node", "pos", "rank", "1").collect()}
    assert [got["s", f"n{i}"] for i in (4, 3, 0, 1, 2)] == [1, 2, 3, 4, 5] and sorted(v for k, v in got.items() if k[0] == "q") == [1, 2, 3, 4]


def test_round_robin_is_even(spark):
    df = spark.createDataFrame([("a", i % 4 if i < 40 else 9, f"i{i}") for i in range(300)], "s string, b int, id string")
    got = sampling.round_robin(df, "s", "b", "id", 22, "1").groupBy("b").count().collect()
    assert sum(r["count"] for r in got) == 22 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1
    assert sampling.round_robin(df.limit(3), "s", "b", "id", 22, "1").count() == 3


def test_feasible_cap(spark):
    def cap(sizes, target):
        return sampling.min_feasible_cap(spark.createDataFrame([(x,) for x in sizes], "n bigint"), target).first().cap

    for sizes, target in [([5, 5, 5], 9), ([1, 100], 50), ([3, 4], 100), ([10], 10), ([7, 7, 2], 12), ([1], 1)]:
        want = next((c for c in range(1, max(sizes) + 1) if sum(min(n, c) for n in sizes) >= target), max(sizes))
        assert cap(sizes, target) == want
    assert cap([], 5) == 0
    assert sampling.site_cap(spark.createDataFrame([(40,), (40,)], "n bigint"), 40).first().cap == 20


def test_hold_out_rounds_half_to_even(spark):
    for k, want in [(2, 1), (25, 2), (35, 4), (1, 1), (15, 2)]:
        df = spark.createDataFrame([(f"w{i % k}", i) for i in range(3 * k)], "w string, x int")
        held = sampling.hold_out(df, "w", "1")
        assert held.where("split = 'val'").count() == want
        both = sampling.with_split(df.withColumn("split", F.lit("old")), "w", held)
        assert both.count() == 3 * k and sampling.shared_groups(both.where("split = 'val'"), both.where("split = 'train'"), "w").count() == 0


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id string, split string, element_correct boolean, operation_correct boolean, step_success boolean, brier double, latency_ms double, usage map<string,double>")


def test_metric_blocks(spark):
    rows = [("1", "a", True, True, True, 0.0, 1.0, {"in": 1.0}), ("2", "overall", False, True, False, 1.0, 2.0, {"in": 2.0, "out": None}), ("3", None, True, False, False, 2.0, None, None), ("4", "", True, False, False, 1.0, 10.0, {})]
    got = {(r.scope, r.split): r for r in scoring.metrics(_scored(spark, rows)).collect()}
    assert set(got) == {("overall", None), ("split", "a"), ("split", "overall")}
    assert got["overall", None].n == 4 and got["overall", None].element_acc == 0.75 and got["overall", None].latency_p50_ms == 2.0
    totals = scoring.usage_totals(_scored(spark, rows))
    assert {(r.key, r.total) for r in totals.collect()} == {("in", 3.0)} and scoring.usage_map(totals).first().usage_total == {"in": 3.0}
    assert scoring.usage_map(scoring.usage_totals(_scored(spark, rows[2:]))).first().usage_total is None
    assert scoring.metrics(_scored(spark, [])).count() in (0, 1)


def _eval(spark, n=40):
    empty = (None,) * 6
    rows = [(f"i{k}", "train", "w", "d", f"open item {k % 10}", [], [(i, "a" if i % 2 else "input", None, f"item {i}", empty) for i in reversed(range(10))], k % 10, "CLICK", None) for k in range(n)]
    df = spark.createDataFrame(rows, EVAL_ROW)
    return df.withColumn("candidates", F.array_sort("candidates", lambda a, b: a.getField("idx") - b.getField("idx")))


def test_predictors_never_see_labels(spark):
    rows = _eval(spark)

    def factory():
        def one(row):
            assert not {"gold_idx", "operation", "value"} & set(row)
            return {"element_probs": [0.1] * 10, "operation_probs": {"CLICK": 1.0}, "usage": {"calls": 1.0}}

        return one

    predict.register("fake", factory)
    got = predict.predict("fake", rows)
    assert got.count() == 40 and got.where("latency_ms >= 0").count() == 40
    with pytest.raises(KeyError):
        predict.predict("none", rows)
    with pytest.raises(ValueError):
        predict.register("first", factory)


def test_predictors_that_take_many_rows(spark):
    class Many:
        def predict_batch(self, rows):
            assert all("gold_idx" not in r for r in rows)
            return [{"element_probs": [float(r["goal"][-1] == str(i)) for i in range(10)], "operation_probs": {"CLICK": 1.0}} for r in rows]

    predict.register("many", Many)
    got = scoring.per_row(_eval(spark), predict.predict("many", _eval(spark)))
    assert got.where("element_correct and latency_ms >= 0").count() == 40


def test_overloaded_services_are_asked_again():
    waits, left = [], [3]

    def call(x):
        if left[0]:
            left[0] -= 1
            raise predict.Overloaded
        return x

    assert predict.retrying(call, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0, 4.0]
    left[0] = 9
    with pytest.raises(predict.Overloaded):
        predict.retrying(call, tries=2, sleep=waits.append)(7)
    assert len(waits) == 4


def test_answers_of_all_forms(spark):
    forms = [
        '{"answers": {"element": {"probabilities": {"a": 3, "b": 1}}}}', '{"element": {"probs": {"a": 0.75, "b": 0.25}}}', '{"element": {"a": 0.3, "b": 0.1, "z": 9}}', '{"answers": {"element": {"label": "b"}}}', '{"element": "a"}',
        '{"element": {"choice": "none"}}', "no json", None, '{"element": {"distribution": {"b": 2}}}',
    ]
    keys = F.array(F.lit("a"), F.lit("b"))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(forms)], "i int, x string").select("i", predict.decode_response(F.col("x"), "element", keys).alias("p"))
    assert [[round(v, 9) for v in r.p] for r in df.orderBy("i").collect()] == [[0.75, 0.25]] * 3 + [[0, 1], [1, 0], [0, 0], [0, 0], [0, 0], [0, 1]]
    logits = spark.createDataFrame([({"A": 1.0, "C": 1.0},), ({},)], "m map<string,double>").select(predict.letter_probabilities(F.col("m"), 3).alias("p"))
    assert [[round(v, 6) for v in r.p] for r in logits.collect()] == [[round(1 / 3, 6)] * 3] * 2


def test_medians_on_many_tasks(spark):
    import random
    import statistics

    rnd = random.Random(3)
    rows = [(str(i), rnd.choice(["a", "b", None]), True, True, True, 0.0, rnd.choice([None, float(rnd.randint(0, 9))]), None) for i in range(301)]
    table = _scored(spark, rows)
    want = {("overall", None): statistics.median([r[6] for r in rows if r[6] is not None])} | {("split", s): statistics.median([r[6] for r in rows if r[1] == s and r[6] is not None]) for s in "ab"}
    for most in (0, 1 << 60):
        got = {(r.scope, r.split): r.latency_p50_ms for r in scoring.metrics(table.repartition(5), most_bytes=most).collect()}
        assert got == want, most
    assert scoring.metrics(_scored(spark, [r for r in rows if r[6] is None]), most_bytes=0).where("latency_p50_ms is not null").count() == 0


def test_repeated_ids_become_one(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "only"), (None, 3, "x"), (None, 2, "y")], "id string, load_no int, v string").withColumn("added_at", F.lit(None).cast("timestamp"))
    few = {(r.id, r.v) for r in scoring.unique_rows(rows).collect()}
    wide = rows.withColumn("c", F.array(F.struct("v")))
    assert few == {(r.id, r.v) for r in scoring.unique_rows(wide, most_bytes=0).collect()}
    monkeypatch.setattr(scoring, "fits", lambda df: False)
    assert few == {(r.id, r.v) for r in scoring.unique_rows(wide, most_bytes=0).collect()} == {(r.id, r.v) for r in scoring.unique_rows(rows).collect()} == {("a", "first"), ("b", "only"), (None, "y")}


def test_native_predictors(spark):
    rows = _eval(spark)
    board = None
    for name in predict.NATIVE:
        one = scoring.per_row(rows, predict.predict(name, rows)).withColumn("adapter", F.lit(name)).withColumn("dataset_name", F.lit("x"))
        board = one if board is None else board.unionByName(one)
    blocks = scoring.metrics(board, "adapter", "dataset_name").cache()
    acc = {r.adapter: r.element_acc for r in blocks.where("scope = 'overall'").collect()}
    assert acc["lexical"] == 1.0 and acc["first"] == 0.1
    gold = spark.createDataFrame([("x", 0.1)], "dataset_name string, gold_first_rate double")
    ok = {r.adapter: r.ok for r in scoring.gates(blocks, gold).collect()}
    assert ok == {"random": None, "first": True, "lexical": True}
    assert [r.adapter for r in scoring.leaderboard(blocks).collect()] == ["random", "first", "lexical"]
    assert "| lexical | 1.000 |" in scoring.markdown(scoring.leaderboard(blocks))


def test_order_ensemble(spark):
    rows = _eval(spark, 5)
    forward, backward = predict.predict("lexical", rows), predict.predict("lexical", predict.reversed_candidates(rows))
    both = {r.id: r.element_probs for r in predict.order_ensemble(forward, backward).collect()}
    for r in forward.collect():
        assert all(abs(a - b) < 1e-12 for a, b in zip(r.element_probs, both[r.id], strict=True))


def test_records_raise(spark):
    rows = _eval(spark, 3)
    got = records.training_records(rows).collect()
    assert got[1].questions.element.label == '[1] <a> "item 1"' and len(got[1].questions.element.criteria) == 10 and sanity.record_faults(records.training_records(rows)).where("n > 0").count() == 0
    with pytest.raises(Exception, match="unknown operation"):
        records.training_records(rows.withColumn("operation", F.lit("HOVER"))).collect()
    twice = rows.withColumn("candidates", F.transform("candidates", lambda c: c.withField("idx", F.lit(1)).withField("text", F.lit("x"))))
    with pytest.raises(Exception, match="not unique"):
        records.training_records(twice).collect()
    assert "gold" not in records.decision_requests(rows, "c").first().request


def test_sanity(spark):
    ok = {r.name: r.ok for r in sanity.checks(_eval(spark)).collect()}
    assert all(ok.values())
    bad = {r.name: r.ok for r in sanity.checks(_eval(spark).unionAll(_eval(spark, 1))).collect()}
    assert not bad["duplicate_ids"] and not bad["all"]
    assert not {r.name: r.ok for r in sanity.checks(_eval(spark).limit(0)).collect()}["all"]


LOG = "trace_uid string, source_step_index bigint, source_step_id string, action_type string, included_in_sft boolean, selector string, html_dom_url string, input_text string, dom_path string, host string, logged_at timestamp"


def test_traces_to_rows(spark):
    log = [("u", i, f"s{i}", ["click", "scroll", "type"][i % 3], True, f"#x{i}", "page", "no input text" if i else "  v ", "a>b> c", "www.h", None) for i in range(7)] + [("z", 0, "s", "click", True, "#x1", "page", None, None, None, None), ("u", 9, "s9", "click", True, "a", "page", None, None, None, None)]
    page = "<div>" + "".join(f"<button id=x{i}>open item {i}</button>" for i in range(12)) + "</div>"
    known = spark.createDataFrame([("u", "open item 3", None, "www.p.q"), ("u", "", None, None), (None, "x", None, None)], "uid string, query string, web_type string, primary_host string")
    asked = traces.step_requests(spark.createDataFrame(log, LOG), known)
    rows = traces.trace_rows(asked, spark.createDataFrame([("page", page)], "html_dom_url string, html string")).collect()
    good = {r.id: r for r in rows if r.skip_reason is None}
    assert set(good) == {f"webchain_u_s{i}" for i in (0, 2, 3, 5, 6)}
    r = good["webchain_u_s6"]
    assert r.website == "p.q" and r.candidates[r.gold_idx].text == "open item 6" and "open item 3" in {c.text for c in r.candidates} and r.previous_actions[-1] == "[type]  c -> TYPE" and len(r.previous_actions) == 5
    assert {r.skip_reason for r in rows} == {None, "target_selector_no_unique_match"}
    odd = traces.trace_rows(asked.withColumn("selector", F.lit("a:::b")), spark.createDataFrame([("page", page)], "html_dom_url string, html string"))
    assert {r.skip_reason for r in odd.collect()} == {"target_selector_unreadable"}
    assert {(r.skip_reason, r.n) for r in steps.skip_counts(asked).collect()} == {("written", 6), ("not_eligible", 2), ("no_goal", 1)}


def test_hot_traces_get_the_same_history(spark):
    log = [("hot" if i % 4 else f"t{i % 8}", i // 2, f"s{i:04d}", "click", True, "a", "p", f"v{i}", None, None, None) for i in range(900)]
    df = spark.createDataFrame(log, LOG)
    one = {(r.trace_uid, r.source_step_id): r.previous_actions for r in traces.with_history(df).collect()}
    two = {(r.trace_uid, r.source_step_id): r.previous_actions for r in traces.with_history(df.repartition(6), hot=50).collect()}
    assert one == two and len(one) == 900


def test_sources_round_trip(spark, tmp_path):
    rows = _eval(spark, 4).withColumn("goal", F.lit("a b\u0085é"))
    files.write_ascii_json(rows, f"{tmp_path}/a")
    raw = files.read_lines(spark, f"{tmp_path}/a").collect()
    assert len(raw) == 4 and all(r.value.isascii() for r in raw)
    back = files.read_rows(spark, f"{tmp_path}/a")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    files.write_json(rows.withColumn("candidates", F.slice("candidates", 1, 9)), f"{tmp_path}/b")
    with pytest.raises(Exception, match="not 10 candidates"):
        files.read_rows(spark, f"{tmp_path}/b").select("candidates").collect()
    files.write_json(rows.limit(0), f"{tmp_path}/c")
    with pytest.raises(ValueError):
        files.read_rows(spark, f"{tmp_path}/c")
    scored = _scored(spark, [("1", "a", True, True, True, 0.0, 1.0, {"in": 1.0})])
    files.write_run(f"{tmp_path}/r1.json", "first", "x", scoring.metrics(scored), {"in": 1.0}, render_mode="default")
    (tmp_path / "r2.json").write_text("{broken")
    runs = files.read_runs(spark, str(tmp_path))
    assert [(r.adapter, r.n) for r in runs.collect()] == [("first", 1)]
    assert files.run_blocks(runs).where("scope = 'overall'").first().element_acc == 1.0
    assert files.round_trip(rows).first()[:] == (4, 0)
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/z.zip", "w") as z:
        z.writestr("in/p_0.json", '[{"annotation_id": "t"}, {"annotation_id": "u"}]')
    staged = files.unpack_zip(spark, f"{tmp_path}/z.zip", "in/p_0.json", f"file://{tmp_path}/staged", piece=7)
    assert {r.annotation_id for r in files.read_tasks(spark, staged).collect()} == {"t", "u"}
    (tmp_path / "ranks.json").write_text('{"scores": {}, "ranks": {"s_1": {"n1": 3, "n2": 0}, "s_2": {}}}')
    assert {tuple(r) for r in files.read_rank_map(spark, f"{tmp_path}/ranks.json").collect()} == {("s_1", "n1", 3), ("s_1", "n2", 0)}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_bytes(b"<a>\xe9</a>")
    assert files.read_pages(spark, f"{tmp_path}/pages").first().html == b"<a>\xe9</a>"
    assert files.shard_paths("d/test_x", 2) == ["d/test_x/test_x_0.json", "d/test_x/test_x_1.json"]


def test_tasks_are_read_from_array_files(spark, tmp_path):
    (tmp_path / "p_0.json").write_text('[{"annotation_id": "t", "actions": [{"action_uid": "a", "pos_candidates": [], "neg_candidates": []}], "action_reprs": ["x"]}, {"annotation_id": "u"}]')
    tasks = files.read_tasks(spark, f"{tmp_path}/p_0.json")
    assert tasks.count() == 2 and steps.explode_steps(tasks).count() == 1


def test_stream_scores_each_file_once(spark, tmp_path):
    from stepmill.streaming import incremental

    rows = _eval(spark, 6)
    files.write_json(predict.predict("first", rows), f"{tmp_path}/in")
    stream = incremental.stream_predictions(spark, f"{tmp_path}/in")
    for _ in range(2):
        incremental.score_stream(stream, rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
