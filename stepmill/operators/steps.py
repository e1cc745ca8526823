"""Step rows: one positive and nine hard negatives, shuffled, with history.

The rules follow the order in which a step can fail, so that every step has
exactly one reason (null for a usable one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.scores import seeded
from stepmill.operators.sampling import with_split

#: Rank of a candidate without one.
NO_RANK = 1_000_000_000
NEGATIVES = 9


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out a single time for each row, however often the body names it and wherever the optimizer copies names to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gold_candidate(pos: Column) -> Column:
    """The first positive marked as the original target, else the first; null for none."""
    marked = F.filter(pos, lambda c: F.coalesce(c.getField("is_original_target"), F.lit(False)))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(pos, F.lit(0)))


def history_slice(reprs: Column, step: Column, last: int = 5) -> Column:
    """The up to ``last`` action strings before the 0-based ``step``, oldest first."""
    n = F.least(F.lit(last), step)
    return F.when(n > 0, F.slice(reprs, F.greatest(step - last, F.lit(0)) + 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def explode_steps(tasks: DataFrame) -> DataFrame:
    """One row per action of every task, with its key, position and history.

    ``posexplode`` by itself would have Spark ask for tasks with actions first,
    and so work out the actions twice where they are computed.
    """
    named = tasks.select("annotation_id", "website", "domain", F.col("confirmed_task").alias("goal"), "action_reprs", F.posexplode_outer("actions").alias("step_idx", "action"))
    each = named.where("step_idx is not null")
    return each.select(
        F.concat_ws("_", "annotation_id", "action.action_uid").alias("step_key"), "annotation_id", "website", "domain", "goal", "step_idx",
        history_slice(F.col("action_reprs"), F.col("step_idx")).alias("previous_actions"),
        F.col("action.cleaned_html").alias("html"), F.col("action.operation.op").alias("operation"), F.nullif(F.col("action.operation.value"), F.lit("")).alias("value"),
        gold_candidate(F.col("action.pos_candidates")).alias("gold"), F.coalesce("action.neg_candidates", F.array()).alias("negs"),
    )


def ranked_negatives(negs: DataFrame, step: str, item: str, pos: str, rank: str, seed: str, k: int = NEGATIVES) -> DataFrame:
    """The ``k`` hardest negatives of every step with their order ``rn``.

    ``negs`` has one row per negative; ``rank`` is null where none is known.
    Least rank first, ties in input order; a step without a single known rank
    takes a seeded random order.  Both orders are cut at ``k`` before the
    shuffle as well as after it (a rank, where there is one, comes first in
    the one order, so a step without any is known by its first row), so a step
    with a third of all negatives sends ``k`` rows from each task.  Ranks are
    below NO_RANK.
    """
    chance = seeded(F.concat_ws(":", step, item, pos), seed)
    by_rank = Window.partitionBy(step).orderBy(F.coalesce(rank, F.lit(NO_RANK)), pos, item)
    by_chance = Window.partitionBy(step).orderBy(chance, pos, item)
    first = negs.withColumn("rn", F.row_number().over(by_rank)).where(F.col("rn") <= k).withColumn("by_rank", F.lit(True))
    drawn = negs.withColumn("rn", F.row_number().over(by_chance)).where(F.col("rn") <= k).withColumn("by_rank", F.lit(False))
    both = first.unionByName(drawn)
    known = F.max((F.col("by_rank") & F.col(rank).isNotNull() & (F.col("rn") == 1)).cast("int")).over(Window.partitionBy(step)) > 0
    return both.withColumn("_known", known).where(F.col("by_rank") == F.col("_known")).drop("_known")


def ordered_negatives(negs: DataFrame, step: str, item: str, pos: str, rank: str, seed: str) -> DataFrame:
    """All negatives of every step with their place ``rn`` in the same order, and ``by_rank``."""
    known = F.max(F.col(rank).isNotNull().cast("int")).over(Window.partitionBy(step)) > 0
    chance = seeded(F.concat_ws(":", step, item, pos), seed)
    order = Window.partitionBy(step).orderBy(F.when(known, F.coalesce(rank, F.lit(NO_RANK)).cast("double")).otherwise(0.0), F.when(~known, chance), pos, item)
    return negs.withColumn("by_rank", known).withColumn("rn", F.row_number().over(order))


def random_negatives(negs: DataFrame, step: str, item: str, pos: str, seed: str, k: int = NEGATIVES) -> DataFrame:
    """``k`` negatives of every step in a seeded random order ``rn``."""
    order = Window.partitionBy(step).orderBy(seeded(F.concat_ws(":", step, item, pos), seed), pos)
    return negs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def refill(ranked: DataFrame, step: str, pos: str, usable: Column, k: int = NEGATIVES) -> DataFrame:
    """The ``k`` negatives kept when some chosen ones cannot be shown.

    ``ranked`` has all negatives with their order ``rn``.  Usable ones among
    the first ``k`` keep their order; the gaps are filled from the rest in
    input order.  ``slot`` numbers them from 1.
    """
    chosen = F.col("rn") <= k
    order = Window.partitionBy(step).orderBy(F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("rn")).otherwise(F.col(pos)))
    return ranked.where(usable).withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k)


def shuffle_place(items: Column, key: Column, seed: str) -> tuple[Column, Column]:
    """(shuffled array, 0-based place of the first item): seeded by key, with ``idx`` renumbered.

    ``items`` is an array of structs with a field ``idx``; the first is the
    gold one.  No row moves: the order is worked out inside the array.
    """
    mixed = F.array_sort(F.transform(items, lambda c, i: F.struct(seeded(F.concat_ws(":", key, i), seed, "shuffle").alias("o"), i.alias("i"), c.alias("c"))))
    placed = F.transform(mixed, lambda m, i: m.getField("c").withField("idx", i.cast("int")))
    gold = F.array_position(F.transform(mixed, lambda m: m.getField("i")), F.lit(0)).cast("int") - 1
    return placed, F.when(gold >= 0, gold)


def variants(steps: DataFrame) -> DataFrame:
    """Every step twice: as it is and augmented, told apart by ``variant`` and the id's ending."""
    both = steps.withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("aug"))))
    return both.withColumn("id", F.when(F.col("variant") == "aug", F.concat("id", F.lit("_aug"))).otherwise(F.col("id")))


def skip_counts(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """(skip_reason, n) with ``written`` for the usable rows."""
    return rows.groupBy(F.coalesce(reason, F.lit("written")).alias("skip_reason")).agg(F.count("*").alias("n"))


def build_rows(steps: DataFrame, ranks: DataFrame, nodes: DataFrame, seed: str = "7", augment: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of ``steps`` (as from ``explode_steps``).

    ``ranks`` is the long rank table, ``nodes`` (step_key, backend_node_id,
    pos, tag, role, text, attrs) the parsed pages.  With ``augment`` every
    usable step gives a second row with random negatives; both variants fill
    gaps from the negatives that neither chose.

    The negatives of a step come out of one array of its row and go back into
    one, with their rank and their node beside them: one join each, one
    grouping, and from then on nothing leaves the row.
    """
    negs = steps.select("step_key", F.posexplode("negs").alias("pos", "c")).select("step_key", "pos", F.col("c.backend_node_id").alias("node"), F.col("c").alias("raw"))
    least = ranks.groupBy("step_key", F.col("backend_node_id").alias("node")).agg(F.min("rank").alias("rank"))
    first_node = nodes.groupBy("step_key", F.col("backend_node_id").alias("node")).agg(F.min_by(F.struct(F.lit(0).alias("idx"), "tag", "role", "text", "attrs"), "pos").alias("shown"))
    held = negs.join(least, ["step_key", "node"], "left").join(first_node, ["step_key", "node"], "left")
    pool = held.groupBy("step_key").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "rank", "raw", "shown"))).alias("pool"))
    gold = first_node.select("step_key", F.col("node").alias("gold_node"), F.col("shown").alias("gold_shown"))
    full = steps.drop("html", "negs").withColumn("gold_node", F.col("gold.backend_node_id")).join(pool, "step_key", "left").join(gold, ["step_key", "gold_node"], "left")
    return _rows(full, seed, augment)


def build_rows_in_place(steps: DataFrame, rank: Callable[[Column, Column], Column], seed: str = "7", augment: bool = False) -> tuple[DataFrame, DataFrame]:
    """``build_rows`` of ``steps`` that hold what they need: nothing is joined, and nothing leaves its row.

    ``rank`` gives the rank of a negative from (step_key, backend_node_id);
    ``shown`` is the array of the nodes of the gold one and of the negatives,
    as from ``nodes_by_id``.
    """
    node = lambda n: F.when(n.isNotNull(), F.struct(F.lit(0).alias("idx"), *[n.getField(k).alias(k) for k in ("tag", "role", "text", "attrs")]))

    def pool(s: Column) -> Column:
        def negative(c: Column, i: Column) -> Column:
            of = c.getField("backend_node_id")
            return F.struct(i.alias("pos"), of.alias("node"), F.when(of.isNotNull(), rank(s.getField("step_key"), of)).alias("rank"), c.alias("raw"), node(F.get(s.getField("shown"), i + 1)).alias("shown"))

        return F.transform(s.getField("negs"), negative)

    held = once(F.struct("step_key", "negs", "shown"), lambda s: F.struct(pool(s).alias("pool"), node(F.get(s.getField("shown"), F.lit(0))).alias("gold_shown")))
    full = steps.withColumn("_held", held).drop("html", "negs", "shown")
    return _rows(full.withColumn("pool", F.col("_held.pool")).withColumn("gold_shown", F.col("_held.gold_shown")).drop("_held"), seed, augment)


def _rows(full: DataFrame, seed: str, augment: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of steps with the node of their gold one and the ``pool`` of their negatives.

    What is chosen is one expression of ``once`` each, and usable steps are
    told by an array to explode and not by a filter: Spark would move the
    filter down and work all of it out again for it.
    """

    def head(s: Column, order) -> Column:
        """The first negatives in an order of their own."""
        laid = F.array_sort(F.transform(s.getField("pool"), lambda x: F.struct(*order(x), x.getField("pos").alias("p"), x.getField("node").alias("n"), x.alias("x"))))
        return F.transform(F.slice(laid, 1, NEGATIVES), lambda y: y.getField("x"))

    def heads(s: Column) -> Column:
        def chance(x: Column, of: str) -> Column:
            return seeded(F.concat_ws(":", s.getField("step_key"), x.getField("node"), x.getField("pos")), of)

        def hardest(x: Column) -> list[Column]:
            ranked = F.coalesce(x.getField("rank"), F.lit(NO_RANK).cast("bigint"))
            return [F.when(s.getField("by_rank"), ranked).otherwise(F.lit(0)).alias("r"), F.when(~s.getField("by_rank"), chance(x, seed)).alias("c")]

        drawn = head(s, lambda x: [chance(x, f"{seed}-aug").alias("c")]) if augment else F.slice(s.getField("pool"), 1, 0)
        return F.struct(head(s, hardest).alias("hard"), drawn.alias("drawn"))

    def rest(s: Column, h: Column) -> Column:
        """Negatives that neither chose; those equal to a chosen one are not among them either."""
        used = F.transform(F.concat(h.getField("hard"), h.getField("drawn")), lambda x: x.getField("raw"))
        return once(used, lambda u: F.filter(s.getField("pool"), lambda x: ~F.array_contains(u, x.getField("raw"))))

    def take(chosen: Column, others: Column) -> Column:
        able = F.filter(F.concat(chosen, others), lambda x: x.getField("shown").isNotNull())
        return F.transform(F.slice(able, 1, NEGATIVES), lambda x: x.getField("shown"))

    def both(s: Column) -> Column:
        kept = lambda h, r: F.struct(take(h.getField("hard"), r).alias("base"), take(h.getField("drawn") if augment else h.getField("hard"), r).alias("aug"))
        return once(heads(s), lambda h: once(rest(s, h), lambda r: kept(h, r)))

    full = full.withColumn("by_rank", F.exists("pool", lambda x: x.getField("rank").isNotNull()))
    full = full.withColumn("_took", once(F.struct("step_key", "pool", "by_rank"), both))
    full = full.withColumn("base", F.col("_took.base")).withColumn("aug", F.col("_took.aug")).drop("_took")
    few = lambda c: F.coalesce(F.array_size(c), F.lit(0)) < NEGATIVES
    reason = (
        F.when(F.col("gold").isNull(), "skip_no_pos")
        .when(few("pool"), "skip_insufficient_neg")
        .when(F.col("gold_shown").isNull(), "skip_gold_not_found")
        .when(few("base"), "skip_neg_not_found")
        .when(few("aug"), "skip_neg_not_found_aug")
    )
    full = full.withColumn("skip_reason", reason)
    kinds = F.array(F.lit("base"), F.lit("aug")) if augment else F.array(F.lit("base"))
    good = full.withColumn("variant", F.explode(F.when(F.col("skip_reason").isNull(), kinds)))
    is_aug = F.col("variant") == "aug"
    good = good.withColumn("id", F.when(is_aug, F.concat("step_key", F.lit("_aug"))).otherwise(F.col("step_key")))
    placed, at = shuffle_place(F.concat(F.array("gold_shown"), F.when(is_aug, F.col("aug")).otherwise(F.col("base"))), F.col("id"), seed)
    rows = good.select("id", F.lit(None).cast("string").alias("split"), "website", "domain", "goal", "previous_actions", placed.alias("candidates"), at.alias("gold_idx"), "operation", "value", F.col("annotation_id").alias("_annotation_id"))
    return rows, full.select("step_key", "skip_reason", "by_rank")


def written(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` as they are written: with the split of their site (as from ``hold_out``), without the task they came from."""
    return with_split(rows, "website", named).drop("_annotation_id")
