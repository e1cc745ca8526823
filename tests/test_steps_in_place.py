"""Step rows out of rows that hold what they need: the same rows as by joins, and a plan in which nothing is kept, joined or worked out twice."""

import os

import pytest
from pyspark.sql import functions as F

from stepmill.functions import html
from stepmill.functions.schema import ATTRS, RANK, TASK
from stepmill.operators import steps
from stepmill.plans import registry
from stepmill.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _kept_in_its_row(df):
    plan = _plan(df)
    return "Join" not in plan and "LogicalRDD" not in plan and "Filter (size(" not in plan and plan.count("ArrowEvalPython") == 1


@tables
def test_step_rows_stay_in_their_row(spark):
    assert _kept_in_its_row(QUERIES["step_rows"](spark, FOLDER))


@tables
def test_step_skips_stay_in_their_row(spark):
    df = QUERIES["step_skips"](spark, FOLDER)
    assert _kept_in_its_row(df) and _plan(df).count("Aggregate") == 3


@tables
@pytest.mark.parametrize("name", ["step_rows", "step_skips"])
def test_candidates_are_sent_to_their_task_once_and_packed(spark, monkeypatch, name):
    told = lambda df: sorted(map(str, df.collect()))
    small = told(QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(registry, "WIDE_BYTES", 0)
    large = QUERIES[name](spark, FOLDER)
    assert "StructsToJson" in _plan(large) and "_twice" in _plan(large) and told(large) == small


def _page(nodes):
    return "".join(f'<a backend_node_id="{n}" class="of-{n}">{t}</a>' for n, t in nodes)


def test_rows_in_place_are_those_by_joins(spark):
    def action(uid, n, missing=(), gold="g", negs=None):
        ids = [f"n{i}" for i in range(n)] if negs is None else negs
        page = _page([(x, f"text {x}") for x in [gold or "g", *(i for i in ids if i)] if x not in missing] + [("n1", "later")])
        return (uid, page, ("CLICK", "v"), [(gold, None)] if gold else [], [(x, None) for x in ids])

    acts = [action("a0", 12), action("a1", 8), action("a2", 12, {"g"}), action("a3", 9, {"n1", "n2"}), action("a4", 12, gold=None), action("a5", 14, {"n0", "n13"}), action("a6", 0), action("a7", 12, negs=["n1", "n1", None, *[f"n{i}" for i in range(2, 12)]])]
    each = steps.explode_steps(spark.createDataFrame([("t", "w", "d", "goal", ["r"] * len(acts), acts), ("u", "w", "d", "goal", [], []), ("v", "w", "d", "goal", None, None)], TASK))
    nodes = each.select("step_key", F.explode(html.page_nodes(F.col("html"))).alias("n")).select("step_key", "n.backend_node_id", "n.pos", "n.tag", "n.role", "n.text", "n.attrs")
    # all ranks but those of a5; none of n3
    known = [(f"t_a{k}", f"n{i}", (i * 7) % 5) for k in (0, 1, 2, 3, 4, 7) for i in range(12) if i != 3]
    rank = lambda step, node: F.when((step != "t_a5") & (node != "n3"), (F.substring(node, 2, 9).cast("bigint") * 7) % 5)
    by_joins = steps.build_rows(each, spark.createDataFrame(known, RANK), nodes, augment=True)
    ids = F.concat(F.array("gold.backend_node_id"), F.transform("negs", lambda c: c.getField("backend_node_id")))
    in_place = steps.build_rows_in_place(each.withColumn("shown", html.nodes_by_id(F.col("html"), ids)), rank, augment=True)
    rows = sorted(in_place[0].collect())
    assert rows and rows == sorted(by_joins[0].collect()) and in_place[0].schema.simpleString() == by_joins[0].schema.simpleString()
    told = lambda df: sorted((r.step_key, str(r.skip_reason), bool(r.by_rank)) for r in df.collect())
    assert told(in_place[1]) == told(by_joins[1]) and len({r[1] for r in told(in_place[1])}) >= 4


def test_nodes_by_id(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES", 2)
    page = '<p backend_node_id="1" class="big-word">a</p><i backend_node_id="1">b</i><em backend_node_id="2" class="long-word 9"></em><b>c</b><u backend_node_id>d</u>'
    df = spark.createDataFrame([(k, p, i) for k, (p, i) in enumerate([(page, ["2", "1", None, "9", "1"]), (None, ["1"]), ("", []), (page, None), (page, [""])])], "k int, h string, ids array<string>").coalesce(1)
    got = {r.k: r.n for r in df.select("k", html.nodes_by_id(F.col("h"), F.col("ids")).alias("n")).collect()}
    assert [n and (n.tag, n.text) for n in got[0]] == [("em", "long word"), ("p", "a"), None, None, ("p", "a")] and got[1] == [None] and got[2] == [] and got[3] == []
    assert got[4][0].text == "d" and list(got[4][0].attrs.asDict()) == list(ATTRS)
