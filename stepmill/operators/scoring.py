"""Scores of predictions: per row, by split, across predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.schema import OPERATIONS
from stepmill.functions.scores import brier, by_keys, first_argmax, pick
from stepmill.operators.ranking import running_sum
from stepmill.session import broadcast_if_small, fits, input_bytes

#: The built-in predictors in the order of the leaderboard; models follow as the caller lists them.
ORDER = ("random", "first", "lexical")
#: From this many rows on a gate is enforced.
LARGE = 200


def one_per_id(rows: DataFrame, *newest: Column, most_bytes: int = 4 << 30) -> DataFrame:
    """One row for each id: the first in the given order.

    Rows are reduced after one shuffle (aggregated before it, no window over
    hot ids).  Large tables of wide rows, those with nested lists, are not
    moved for the few rows that repeat: repeated ids are found on the id alone,
    and where they are few they are sent to the rows, and only rows that have
    one are shuffled.  Below ``most_bytes`` of input one shuffle costs less
    than that second look; the result is the same.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    first = lambda df: df.groupBy("id").agg(F.min_by(row, F.struct(*newest)).alias("r")).select("r.*")
    if not any("array<struct" in kind for _, kind in rows.dtypes) or input_bytes(rows) <= most_bytes:
        return first(rows)
    twice = rows.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col("id").alias("_id"), F.lit(True).alias("_twice"))
    if not fits(twice):
        return first(rows)
    marked = rows.join(F.broadcast(twice), F.col("id").eqNullSafe(F.col("_id")), "left")
    return marked.where("_twice is null").select(*rows.columns).unionByName(first(marked.where("_twice").select(*rows.columns)))


def unique_predictions(predictions: DataFrame) -> DataFrame:
    """One prediction for each id; of repeated ones that with the greatest latency (null least), then the greater first probabilities."""
    late = F.coalesce(-F.col("latency_ms"), F.lit(float("inf")))
    return one_per_id(predictions, late, F.concat_ws(",", F.transform("element_probs", lambda p: F.format_number(1 - p, 6))))


def unique_rows(rows: DataFrame, most_bytes: int = 4 << 30) -> DataFrame:
    """One row for each id: the earliest delivery; ``most_bytes`` as in ``one_per_id``."""
    return one_per_id(rows, F.coalesce("load_no", F.lit(0)), F.coalesce("added_at", F.timestamp_micros(F.lit(0))), most_bytes=most_bytes)


def per_row(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each row beside its prediction: what was predicted, whether it is right, how far off.

    Ids are unique on both sides (see ``unique_rows``); rows without a
    prediction are left out.  A null gold is never right.
    """
    gold = rows.select("id", "split", "website", "gold_idx", "operation")
    return score(gold.join(predictions.select("id", "element_probs", "operation_probs", "latency_ms", "usage"), "id"))


def score(predicted: DataFrame, *by: str) -> DataFrame:
    """``per_row`` of rows that carry their prediction, with the columns ``by`` kept."""
    got = predicted.withColumn("gold_op", F.col("operation"))
    at = first_argmax(F.col("element_probs"))
    op = pick(OPERATIONS, first_argmax(by_keys(F.col("operation_probs"), OPERATIONS)))
    full = got.withColumn("pred_idx", at).withColumn("pred_op", op)
    element = F.coalesce(F.col("pred_idx") == F.col("gold_idx"), F.lit(False))
    operation = F.coalesce(F.col("pred_op") == F.col("gold_op"), F.lit(False))
    return full.select(
        *by, "id", "split", "website", "pred_idx", "gold_idx", "pred_op", "gold_op", element.alias("element_correct"), operation.alias("operation_correct"),
        (element & operation).alias("step_success"), brier(F.col("element_probs"), F.col("gold_idx")).alias("brier"), F.array_max("element_probs").alias("top_prob"), "latency_ms", "usage",
    )


def _block() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("int"))
    return [
        F.count("*").alias("n"), share("element_correct").alias("element_acc"), share("operation_correct").alias("operation_acc"), share("step_success").alias("step_success"),
        F.avg("brier").alias("brier"), F.avg("latency_ms").alias("latency_mean_ms"),
    ]


def middle(values: DataFrame, by: list[str], of: str) -> DataFrame:
    """(by.., p50): the exact median of ``of`` in every group, worked out on many tasks.

    Equal values are counted first; the counts are laid along one order, so a
    group of any size is spread over many partitions, and the one or two
    middle values are read off the running sum.  Nulls count for nothing.
    """
    counts = values.where(F.col(of).isNotNull()).groupBy(*by, of).agg(F.count("*").alias("_n"))
    laid = running_sum(counts, [*by, of], "_n")
    ends = laid.groupBy(*by).agg(F.min(F.col("upto") - F.col("_n")).alias("_lo"), F.max("upto").alias("_hi"))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in by], "_lo", "_hi")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = laid.join(broadcast_if_small(ends), same)
    at = lambda k: (F.col("upto") - F.col("_n") <= k) & (F.col("upto") > k)
    low = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo") - 1) / 2)
    high = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2)
    hit = both.where(at(low) | at(high)).withColumn("_w", at(low).cast("int") + at(high).cast("int"))
    return hit.groupBy(*by).agg((F.sum(F.col(of) * F.col("_w")) / 2).alias("p50"))


def metrics(scored: DataFrame, *by: str, most_bytes: int = 1 << 30) -> DataFrame:
    """The metric block overall and for each split, one pass of grouping sets.

    The median holds the distinct latencies of a group in one task, so it is
    taken in that pass only where the files read are at most ``most_bytes``;
    beyond that ``middle`` gives the same on many tasks.

    ``scope`` is 'overall' or 'split', so that a split of that name stays
    apart.  Null and empty splits count in the overall block alone; no rows
    give no blocks.
    """
    # the input doubles (not one copy per measure), since only one column is expanded
    sets = scored.groupingSets([[*by], [*by, "split"]], *by, "split")
    small = input_bytes(scored) <= most_bytes
    p50 = F.median("latency_ms") if small else F.lit(None).cast("double")
    out = sets.agg(*_block(), p50.alias("latency_p50_ms"), F.grouping("split").alias("_all"))
    kept = out.where((F.col("_all") == 1) | (F.coalesce("split", F.lit("")) != ""))
    scope = F.when(F.col("_all") == 1, "overall").otherwise("split")
    blocks = kept.select(*by, scope.alias("scope"), F.when(F.col("_all") == 0, F.col("split")).alias("split"), "n", "element_acc", "operation_acc", "step_success", "brier", "latency_mean_ms", "latency_p50_ms")
    if small:
        return blocks
    both = scored.select(*by, F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("split")), F.struct(F.lit("split").alias("scope"), F.col("split").alias("split")))).alias("s"), "latency_ms")
    half = middle(both.select(*by, "s.scope", "s.split", "latency_ms"), [*by, "scope", "split"], "latency_ms")
    half = half.select(*[F.col(c).alias(f"_{c}") for c in (*by, "scope", "split")], "p50")
    same = F.lit(True)
    for c in (*by, "scope", "split"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return blocks.join(half, same, "left").withColumn("latency_p50_ms", F.col("p50")).select(*blocks.columns)


def usage_totals(scored: DataFrame, *by: str) -> DataFrame:
    """(by.., key, total): sums of an open-keyed map; null values count for nothing."""
    each = scored.select(*by, F.explode("usage").alias("key", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return each.groupBy(*by, "key").agg(F.sum("value").alias("total"))


def usage_map(totals: DataFrame) -> DataFrame:
    """The totals as one map, null where there are none."""
    one = totals.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "total")))).alias("usage_total"))
    return one.select(F.when(F.size("usage_total") > 0, F.col("usage_total")).alias("usage_total"))


def leaderboard(results: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """Overall blocks of (adapter, dataset_name), datasets sorted, the built-in adapters and then ``models`` in their order; others are left out."""
    place = F.array_position(F.array(*[F.lit(a) for a in (*ORDER, *models)]), F.col("adapter"))
    kept = results.where((F.col("scope") == "overall") & (place > 0)).withColumn("place", place.cast("int"))
    return kept.select("dataset_name", "place", "adapter", "element_acc", "operation_acc", "step_success", "brier", "latency_mean_ms", "latency_p50_ms", "n").orderBy("dataset_name", "place")


def gates(results: DataFrame, gold_first: DataFrame) -> DataFrame:
    """(adapter, dataset_name, gate, ok, value, reference): ok is null where a gate is not enforced.

    ``gold_first`` has the rate of gold_idx = 0 by dataset_name.  A model gate
    asks for more than three points between model and chance on either side;
    the signed difference can be read off value and reference.
    """
    own = results.where("scope = 'overall'").select("adapter", "dataset_name", "n", "element_acc")
    chance = own.where("adapter = 'random'").select("dataset_name", F.col("element_acc").alias("random_acc"))
    both = own.join(chance, "dataset_name", "left").join(gold_first, "dataset_name", "left")
    large, acc, rnd, model = F.col("n") >= LARGE, F.col("element_acc"), F.col("random_acc"), ~F.col("adapter").isin(*ORDER)
    gate = F.when(F.col("adapter") == "random", "random element accuracy in [5%,15%]").when(F.col("adapter") == "first", "first element accuracy equals the rate of gold at 0").when(F.col("adapter") == "lexical", "lexical beats random").when(model, "differs from random by more than 3 points")
    ok = (
        F.when((F.col("adapter") == "random") & large, acc.between(0.05, 0.15))
        .when(F.col("adapter") == "first", F.abs(acc - F.col("gold_first_rate")) < 1e-9)
        .when((F.col("adapter") == "lexical") & rnd.isNotNull(), acc > rnd)
        .when(model & rnd.isNotNull() & large, F.abs(acc - rnd) > 0.03)
    )
    reference = F.when(F.col("adapter") == "first", F.col("gold_first_rate")).when(F.col("adapter") != "random", rnd)
    return both.where(gate.isNotNull()).select("adapter", "dataset_name", gate.alias("gate"), ok.alias("ok"), acc.alias("value"), reference.alias("reference"))


def chart_rows(results: DataFrame) -> DataFrame:
    """The three accuracies in percent, as the bar chart shows them."""
    hundred = [F.round(F.col(c) * 100, 6).alias(c) for c in ("element_acc", "operation_acc", "step_success")]
    return results.where("scope = 'overall'").select("adapter", "dataset_name", *hundred)


def suspect_rows(rows: DataFrame, scored: DataFrame, n: int = 5) -> DataFrame:
    """The candidates of the first ``n`` wrongly predicted rows, gold and choice marked."""
    wrong = scored.where("not element_correct").orderBy("id").limit(n).select("id", "pred_idx", F.col("gold_idx").alias("gold"))
    return rows.join(F.broadcast(wrong), "id").select("id", F.explode("candidates").alias("c"), "gold", "pred_idx").select("id", "c.idx", "c.tag", "c.text", (F.col("c.idx") == F.col("gold")).alias("is_gold"), (F.col("c.idx") == F.col("pred_idx")).alias("is_pred"))


def markdown(board: DataFrame) -> str:
    """The leaderboard as Markdown; it has one row for each predictor and dataset, so it is collected."""
    lines: list[str] = []
    last = None
    for r in board.collect():
        if r.dataset_name != last:
            lines += ["", f"## {r.dataset_name}", "", "| adapter | element acc | op acc | step success | brier | latency mean ms | latency p50 ms | n |", "|---|---|---|---|---|---|---|---|"]
            last = r.dataset_name
        show = lambda v, d: "" if v is None else f"{v:.{d}f}"
        lines.append(f"| {r.adapter} | {show(r.element_acc, 3)} | {show(r.operation_acc, 3)} | {show(r.step_success, 3)} | {show(r.brier, 3)} | {show(r.latency_mean_ms, 2)} | {show(r.latency_p50_ms, 2)} | {r.n} |")
    return "\n".join(lines).lstrip("\n") + "\n"


def histogram(rows: DataFrame, column: str = "gold_idx", buckets: int = 10) -> DataFrame:
    """(bucket, n, share) for 0..buckets-1, zero where empty; shares are of all rows with a bucket."""
    have = rows.where(F.col(column).between(0, buckets - 1)).groupBy(F.col(column).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(F.broadcast(have), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return filled.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy()).cast("double")))
