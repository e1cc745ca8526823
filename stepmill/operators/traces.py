"""The second source: an action log and its traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.html import is_readable, page_nodes
from stepmill.functions.scores import seeded
from stepmill.functions.text import clean_value, site_of, value_overlap
from stepmill.operators.ranking import position
from stepmill.operators.steps import shuffle_place
from stepmill.session import broadcast_if_small

# Recorded action types and the operations they stand for.
ACTION_TYPES = {"click": "CLICK", "type": "TYPE", "select": "SELECT"}


def operation_of(action_type: Column) -> Column:
    """The operation of an action type; unknown types stay as they are."""
    codes = F.create_map(*[F.lit(x) for kv in ACTION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, action_type), action_type)


def is_eligible() -> Column:
    """Known type, kept for training, with a selector and a page; nulls count as no."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.coalesce(F.col("action_type").isin(*ACTION_TYPES), F.lit(False)) & F.coalesce("included_in_sft", F.lit(False)) & there("selector") & there("html_dom_url")


def action_label() -> Column:
    """``[type] label -> OP``: what was typed, else the end of the element's path, cut at 40."""
    typed = F.when(F.col("input_text").isNotNull() & ~F.col("input_text").isin("", "no input text"), F.col("input_text"))
    path = F.element_at(F.split(F.coalesce("dom_path", F.lit("")), ">"), -1)
    kind = F.coalesce("action_type", F.lit("None"))
    return F.concat(F.lit("["), kind, F.lit("] "), F.substring(F.coalesce(typed, path), 1, 40), F.lit(" -> "), F.coalesce(operation_of(F.col("action_type")), F.lit("None")))


def with_history(actions: DataFrame, last: int = 5, tiebreak: tuple[str, ...] = ("logged_at", "source_step_id"), hot: int = 200_000) -> DataFrame:
    """``actions`` with ``previous_actions``: the labels of the ``last`` actions before each, oldest first.

    All actions count, eligible or not.  A trace of ordinary length is one
    window with a bounded frame.  Traces of more than ``hot`` actions are laid
    along one order and cut into blocks, each with the ``last`` rows before
    it, so that none of them is one task's work.
    """
    order = ("source_step_index", *tiebreak)
    label = action_label()
    plain = Window.partitionBy("trace_uid").orderBy(*order).rowsBetween(-last, -1)
    long = actions.groupBy("trace_uid").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(F.col("trace_uid").alias("_uid"), F.lit(True).alias("_hot"))
    if long.isEmpty():
        return actions.withColumn("previous_actions", F.collect_list(label).over(plain))
    # traces that long are few among all actions, however many; the flag is joined, sent to the rows where it fits
    told = actions.join(broadcast_if_small(long), F.col("trace_uid").eqNullSafe(F.col("_uid")), "left").drop("_uid")
    short = told.where("_hot is null").drop("_hot").withColumn("previous_actions", F.collect_list(label).over(plain))
    laid = position(told.where("_hot").drop("_hot"), ["trace_uid", *order])
    inside = laid.withColumn("_block", F.floor(F.col("pos") / hot)).withColumn("_lead", F.lit(False))
    lead = inside.where(F.col("pos") % hot >= hot - last).withColumn("_block", F.col("_block") + 1).withColumn("_lead", F.lit(True))
    block = Window.partitionBy("trace_uid", "_block").orderBy("pos").rowsBetween(-last, -1)
    blocks = inside.unionByName(lead).withColumn("previous_actions", F.collect_list(label).over(block)).where(~F.col("_lead"))
    return short.unionByName(blocks.drop("pos", "_block", "_lead"))


def unique_traces(traces: DataFrame) -> DataFrame:
    """One row per ``uid``: of repeated ones that with a query, then the greatest."""
    pick = F.struct((F.coalesce("query", F.lit("")) != "").alias("has"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "web_type", "primary_host")], F.struct("query", "web_type", "primary_host").alias("row"))
    return traces.where("uid is not null").groupBy("uid").agg(F.max(pick).alias("p")).select("uid", "p.row.query", "p.row.web_type", "p.row.primary_host")


def step_requests(actions: DataFrame, traces: DataFrame) -> DataFrame:
    """Every action with its history, goal, site and ``skip_reason`` (null: usable)."""
    known = unique_traces(traces)
    full = with_history(actions).join(known, F.col("trace_uid") == F.col("uid"), "left")
    reason = F.when(~is_eligible(), "not_eligible").when(F.coalesce("query", F.lit("")) == "", "no_goal")
    return full.select(
        F.concat_ws("_", F.lit("webchain"), "trace_uid", "source_step_id").alias("id"), "trace_uid", "source_step_index", F.col("query").alias("goal"),
        site_of(F.col("primary_host"), F.col("host")).alias("website"), F.coalesce("web_type", F.lit("")).alias("domain"), "previous_actions",
        operation_of(F.col("action_type")).alias("operation"), clean_value(F.col("input_text")).alias("value"), "selector", "html_dom_url", reason.alias("skip_reason"),
    )


def hardest_by_overlap(pool: DataFrame, step: str, goal: Column, cand: Column, key: Column, seed: str, k: int = 9) -> DataFrame:
    """The ``k`` candidates of every step that share most tokens with the goal, ties by seeded chance (``rn``)."""
    scored = pool.withColumn("score", value_overlap(goal, cand)).withColumn("_chance", seeded(key, seed, "negs"))
    order = Window.partitionBy(step).orderBy(F.desc("score"), "_chance")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("_chance")


def trace_rows(requests: DataFrame, pages: DataFrame, seed: str = "7") -> DataFrame:
    """Rows and skip reasons of ``requests`` given ``pages`` (html_dom_url, html).

    The selector must be understood and match one node; of the other interactive nodes the nine
    that share most tokens with the goal are the negatives.  Pages are parsed
    only for requests that are usable so far.  All work on a page stays inside
    its row.
    """
    open_ = requests.where("skip_reason is null").join(pages, "html_dom_url", "left").withColumn("nodes", page_nodes(F.col("html"), F.col("selector")))
    shown = lambda n: F.struct(F.lit(0).alias("idx"), n.getField("tag").alias("tag"), n.getField("role").alias("role"), n.getField("text").alias("text"), n.getField("attrs").alias("attrs"))
    hits = F.filter("nodes", lambda n: F.array_contains(n.getField("matches"), 0))
    parsed = open_.withColumn("hits", hits).withColumn("target", F.get(F.col("hits"), F.lit(0)))
    pool = F.filter("nodes", lambda n: F.array_contains(n.getField("matches"), 1) & (n.getField("pos") != F.col("target.pos")))
    scored = F.array_sort(
        F.transform(
            F.col("pool"),
            lambda n: F.struct((-value_overlap(F.col("goal"), n)).alias("s"), seeded(F.concat_ws(":", F.col("id"), n.getField("pos")), seed, "negs").alias("c"), shown(n).alias("n")),
        )
    )
    reason = F.when(~is_readable("selector"), "target_selector_unreadable").when(F.coalesce(F.array_size("hits"), F.lit(0)) != 1, "target_selector_no_unique_match").when(F.coalesce(F.array_size("pool"), F.lit(0)) < 9, "insufficient_pool")
    full = parsed.withColumn("pool", pool).withColumn("skip_reason", reason).withColumn("negs", F.transform(F.slice(scored, 1, 9), lambda x: x.getField("n")))
    placed, at = shuffle_place(F.concat(F.array(shown(F.col("target"))), F.col("negs")), F.col("id"), seed)
    return full.select("id", F.lit(None).cast("string").alias("split"), "website", "domain", "goal", "previous_actions", F.when(F.col("skip_reason").isNull(), placed).alias("candidates"), F.when(F.col("skip_reason").isNull(), at).alias("gold_idx"), "operation", "value", "skip_reason")
