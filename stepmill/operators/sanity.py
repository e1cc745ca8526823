"""Checks over whole data sets, each a figure and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepmill.functions.schema import OPERATIONS
from stepmill.functions.text import strip
from stepmill.operators.scoring import histogram

#: Share of gold positions that each place may have, and of gold texts that must not be blank.
BAND, TEXT_SHARE = (0.06, 0.14), 0.95


def checks(rows: DataFrame) -> DataFrame:
    """(name, value, ok): duplicate ids, bad candidate lists, uniform gold places, gold texts, and all together.

    One pass gives the counts, a second the histogram; no rows give failed
    shares (null values count as not ok).
    """
    idx = F.array_sort(F.transform("candidates", lambda c: c.getField("idx")))
    bad = ~F.coalesce((F.size("candidates") == 10) & (idx == F.sequence(F.lit(0), F.lit(9))), F.lit(False))
    gold = F.get(F.filter("candidates", lambda c: c.getField("idx") == F.col("gold_idx")), F.lit(0)).getField("text")
    shown = F.coalesce(strip(gold) != "", F.lit(False))
    one = rows.agg(
        (F.count("id") - F.count_distinct("id")).cast("double").alias("duplicate_ids"),
        F.count_if(bad).cast("double").alias("bad_candidates"),
        F.avg(shown.cast("int")).alias("gold_text_share"),
    )
    places = histogram(rows).agg(F.struct(F.min("share").alias("low"), F.max("share").alias("high"))).scalar()
    both = one.withColumn("places", places).select("*", "places.low", "places.high")
    band = F.coalesce((F.col("low") >= BAND[0]) & (F.col("high") <= BAND[1]), F.lit(False))
    oks = [("duplicate_ids", F.col("duplicate_ids"), F.col("duplicate_ids") == 0), ("bad_candidates", F.col("bad_candidates"), F.col("bad_candidates") == 0), ("gold_place_low", F.col("low"), band), ("gold_place_high", F.col("high"), band), ("gold_text_share", F.col("gold_text_share"), F.coalesce(F.col("gold_text_share") >= TEXT_SHARE, F.lit(False)))]
    everything = oks[0][2] & oks[1][2] & band & oks[4][2]
    lines = [F.struct(F.lit(n).alias("name"), v.alias("value"), ok.alias("ok")) for n, v, ok in oks] + [F.struct(F.lit("all").alias("name"), F.lit(None).cast("double").alias("value"), everything.alias("ok"))]
    return both.select(F.explode(F.array(*lines)).alias("c")).select("c.*")


def top_groups(rows: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent groups and the number of distinct ones; ties by name."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    distinct = counts.agg(F.count(group)).scalar()
    return counts.where(F.col(group).isNotNull()).orderBy(F.desc("n"), group).limit(n).withColumn("distinct_groups", distinct)


def written_totals(rows: DataFrame, shard: str = "load_no") -> DataFrame:
    """(split, shard, n, tasks): rows and tasks by split and shard, with totals (null shard, then null split)."""
    named = rows.select(F.coalesce("split", F.lit("")).alias("split"), F.col(shard).alias("shard"), "_annotation_id")
    out = named.rollup("split", "shard").agg(F.count("*").alias("n"), F.count_distinct("_annotation_id").alias("tasks"), F.grouping_id().alias("level"))
    return out.select(F.col("level").cast("int").alias("level"), "split", "shard", "n", "tasks")


def record_faults(records: DataFrame) -> DataFrame:
    """(rule, n): how many training records break each rule of their form."""
    e, o = F.col("questions.element"), F.col("questions.operation")
    rules = {
        "element_options_not_10": F.size(F.map_keys(e.getField("criteria"))) != 10,
        "element_label_not_an_option": ~F.map_contains_key(e.getField("criteria"), e.getField("label")),
        "operation_unknown": ~o.getField("label").isin(*OPERATIONS),
        "operation_options_differ": F.array_sort(F.map_keys(o.getField("criteria"))) != F.array(*[F.lit(x) for x in sorted(OPERATIONS)]),
        "type_not_choice": (e.getField("type") != "choice") | (o.getField("type") != "choice"),
        "state_without_goal": ~F.col("state").startswith("Goal: "),
        "id_missing": F.col("_meta.id").isNull(),
        "criteria_with_values": F.exists(F.map_values(e.getField("criteria")), lambda v: v.isNotNull()),
    }
    counts = records.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("r")).select("r.*")
