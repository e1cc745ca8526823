"""Problem 4: a sample that matches target proportions.

Systematic unequal-probability sampling: within sorted categories the ids lie
in random order, their inclusion probabilities are added up across
partitions, and an id is chosen where the running sum passes a whole number
counted from one random start.  Categories below their minimum are then
filled up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.session import broadcast_if_small, cut

TARGETS = "target_set string, field string, category string, share_pct int, sample_pct int, min_rows int"


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def start_of(target_set: str, seed: str) -> float:
    """The one random start of a target set."""
    return int(hashlib.md5(f"{seed}:start:{target_set}".encode()).hexdigest()[:13], 16) / 2**52


def members(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(id, cats): every distinct id with its categories in each field, an array of (field, values).

    One shuffle by id, partly aggregated before it; copies of an id agree as a
    rule, so the sets hold one value each.
    """
    sets = [F.collect_set(F.col(f).cast("string")).alias(f"_f{i}") for i, f in enumerate(fields)]
    one = rows.where("id is not null").groupBy("id").agg(*sets) if fields else rows.where("id is not null").select("id").distinct()
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("values")) for i, f in enumerate(fields)]
    none = F.array().cast("array<struct<field:string,values:array<string>>>")
    return one.select("id", (F.array(*pairs) if pairs else none).alias("cats"))


def plan(rows: DataFrame, targets: DataFrame, most_targets: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(members, report), members as from ``members``; the report has one row per target with what is there and what it asks for.

    Nulls among the figures of a target count as 0.  ``unmet`` is true where a * 10000 < share_pct * sample_pct * n or
    a < min_rows, with a distinct ids of the category and n in all.
    """
    names = [f.strip().split()[0] for f in TARGETS.split(",")]
    goals = targets.select([F.coalesce(n, F.lit(0)).alias(n) if n in names[3:] else F.col(n) for n in names]).distinct().limit(most_targets + 1).collect()
    if len(goals) > most_targets:
        raise ValueError("targets are a small table; this one is not")
    spark = rows.sparkSession
    fields = sorted({g.field for g in goals if g.field is not None and g.field in rows.columns})
    each = cut(members(rows, fields))
    n = each.count()
    fixed = spark.createDataFrame([tuple(g) for g in goals], TARGETS)
    # counts by category, pre-aggregated; categories can be as many as sites, so this stays a table
    held = each.select(F.explode("cats").alias("c")).select("c.field", F.explode("c.values").alias("category"))
    counts = held.groupBy("field", "category").agg(F.count("*").alias("have"))
    report = fixed.join(counts, ["field", "category"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint"))).withColumn("n", F.lit(n).cast("bigint"))
    short = F.col("have") * 10000 < F.col("share_pct").cast("bigint") * F.col("sample_pct") * F.col("n")
    few = F.col("have") < F.col("min_rows")
    asked = F.col("share_pct").cast("double") * F.col("sample_pct") * F.col("n") / 10000
    report = report.select(
        "target_set", "field", "category", "share_pct", "sample_pct", "min_rows", "have", "n",
        F.least(F.greatest(asked, F.coalesce(F.col("min_rows"), F.lit(0)).cast("double")), F.col("have").cast("double")).alias("draw"),
        F.coalesce(short | few, F.lit(False)).alias("unmet"),
    )
    return each, cut(report)


def draw(rows: DataFrame, targets: DataFrame, seed: str = "stepmill") -> tuple[DataFrame, DataFrame]:
    """(sample, report) for ``targets``; sample has (target_set, id, category, topped_up).

    Ids whose category has no target share what the targets leave of the
    sample's size.  A category with fewer ids than asked is taken whole.  Rows
    with a null id take no part; an id with a null value belongs to no
    category; no rows give an empty sample and every minimum unmet.  The same
    rows and seed give the same sample on any partitioning.
    """
    sample, report, _ = _drawn(rows, targets, seed)
    return sample, report


def _drawn(rows: DataFrame, targets: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, report, left): as ``draw``, and (target_set, category, left) with the number of ids of each target's category that are not drawn."""
    each, report = plan(rows, targets)
    goals = report.collect()
    spark = rows.sparkSession
    sets: dict[str, dict] = {}
    for g in goals:
        s = sets.setdefault(g.target_set, {"field": g.field, "size": round(g.sample_pct * g.n / 100), "n": g.n, "draw": 0.0, "have": 0, "share": 0})
        s["draw"] += g.draw
        s["have"] += g.have
        s["share"] += g.share_pct
    per_set = spark.createDataFrame(
        [(k, s["field"], min(1.0, max(0.0, s["size"] - s["draw"]) / (s["n"] - s["have"])) if s["n"] > s["have"] else 0.0, start_of(k, seed)) for k, s in sorted(sets.items())] or [("", "", 0.0, 0.0)],
        "target_set string, field string, rest double, start double",
    )
    wanted = report.select("target_set", "category", F.when(F.col("have") > 0, F.col("draw") / F.col("have")).otherwise(0.0).alias("p"), F.least("min_rows", "have").alias("least"))
    # an id with several values counts once, with the least; null where it has none
    single = each.select("id", F.explode("cats").alias("c")).select("id", "c.field", F.array_min("c.values").alias("category"))
    # the targets are a small table by contract, so both lookups are sent to the rows
    laid = single.join(F.broadcast(per_set), "field").join(F.broadcast(wanted), ["target_set", "category"], "left")
    laid = laid.withColumn("p", F.least(F.lit(1.0), F.coalesce("p", "rest"))).withColumn("u", uniform(F.col("id"), seed))
    ranked = _rank(laid.where("p > 0").select("target_set", "category", "u", "id", "p"))
    ranked = ranked.join(F.broadcast(per_set.select("target_set", "start")), "target_set").join(F.broadcast(wanted.drop("p")), ["target_set", "category"], "left")
    low, high = F.col("before") - F.col("start"), F.col("before") + F.col("p") - F.col("start")
    hit = F.ceil(high - F.lit(1e-9)) > F.ceil(low - F.lit(1e-9))
    chosen = ranked.withColumn("hit", hit).select("target_set", "category", "u", "id", "hit", "least")
    tally = cut(chosen.where("least is not null").groupBy("target_set", "category").agg(F.count_if("hit").alias("got"), F.count_if(~F.col("hit")).alias("missed")))
    need = wanted.where("least > 0").join(tally, ["target_set", "category"], "left").select("target_set", "category", (F.col("least") - F.coalesce("got", F.lit(0))).alias("need")).where("need > 0")
    left = tally.join(F.broadcast(need), ["target_set", "category"], "left").select("target_set", "category", F.greatest(F.col("missed") - F.coalesce("need", F.lit(0)), F.lit(0)).alias("left"))
    spare = chosen.where("not hit").join(F.broadcast(need), ["target_set", "category"])
    first = Window.partitionBy("target_set", "category").orderBy("u", "id")
    extra = spare.withColumn("k", F.row_number().over(first)).where(F.col("k") <= F.col("need"))
    sample = chosen.where("hit").select("target_set", "id", "category", F.lit(False).alias("topped_up"))
    return sample.unionAll(extra.select("target_set", "id", "category", F.lit(True).alias("topped_up"))), report, left


def _rank(laid: DataFrame) -> DataFrame:
    """``laid`` with ``before``: the sum of ``p`` of all ids of the target set that come earlier.

    Rows are range-partitioned by (set, category, u, id) and written; per
    partition and category one count is added up, so a category that holds a
    third of the rows is spread over many partitions.
    """
    keys = ["target_set", "category", "u", "id"]
    sorted_rows = laid.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_at", 33))
    runs = placed.groupBy("target_set", "_pid", "category").agg(F.count("*").alias("_n"), F.max("p").alias("_p"), F.min("_at").alias("_first"))
    order = Window.partitionBy("target_set").orderBy("_pid", "_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_off", F.coalesce(F.sum(F.col("_n") * F.col("_p")).over(order), F.lit(0.0))).select(F.col("target_set").alias("_set"), F.col("_pid").alias("_part"), F.col("category").alias("_cat"), "_first", "_off")
    # one row for each partition and each category that begins in it: sent to the rows if that is few, else joined by shuffle
    offsets = broadcast_if_small(cut(offsets))
    same = (F.col("target_set") == F.col("_set")) & (F.col("_pid") == F.col("_part")) & F.col("category").eqNullSafe(F.col("_cat"))
    joined = placed.join(offsets, same)
    return joined.withColumn("before", F.col("_off") + (F.col("_at") - F.col("_first")) * F.col("p")).select(*keys, "p", "before")


def unreached(rows: DataFrame, targets: DataFrame, seed: str = "stepmill") -> DataFrame:
    """(target_set, category): the targets that the sample of ``draw`` cannot meet.

    Read off the sample: a target is out of reach where no id of its category
    is left undrawn and what there is falls short of the share or the minimum,
    by the exact figures of ``plan``.
    """
    _, report, left = _drawn(rows, targets, seed)
    spent = F.coalesce("left", F.lit(0)) == 0
    return report.join(F.broadcast(left), ["target_set", "category"], "left").where(spent & F.col("unmet")).select("target_set", "category")


def quota_report(sample: DataFrame, report: DataFrame) -> DataFrame:
    """The report with what was drawn: (target_set, category, wanted_pct, have, asked, drawn, drawn_pct, unmet)."""
    got = sample.groupBy("target_set", "category").agg(F.count("*").alias("drawn"))
    sizes = sample.groupBy("target_set").agg(F.count("*").alias("size"))
    full = report.join(got, ["target_set", "category"], "left").join(sizes, "target_set", "left")
    return full.select(
        "target_set", "category", F.col("share_pct").alias("wanted_pct"), "have", F.round("draw", 3).alias("asked"),
        F.coalesce("drawn", F.lit(0)).cast("bigint").alias("drawn"),
        F.round(100 * F.coalesce("drawn", F.lit(0)) / F.col("size"), 3).alias("drawn_pct"), "unmet",
    )
