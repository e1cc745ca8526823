"""Deterministic samples, caps, hold-outs and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.functions.scores import seeded
from stepmill.operators.ranking import position
from stepmill.session import broadcast_if_small


def round_robin(rows: DataFrame, stratum: str, bucket: str, key: str, take: int, seed: str) -> DataFrame:
    """Up to ``take`` rows of every stratum, dealt one at a time from its buckets in a seeded order.

    Dealing equals the order (rank inside the bucket, place of the bucket).
    No bucket needs more than ``take`` rows, so that limit is applied first,
    already before the shuffle, and a hot bucket shrinks to it.
    """
    inside = Window.partitionBy(stratum, bucket).orderBy(seeded(F.col(key), seed), key)
    dealt = rows.withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") <= take)
    place = F.concat_ws(":", F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.coalesce(F.col(bucket).cast("string"), F.lit("")))
    order = Window.partitionBy(stratum).orderBy("_rn", seeded(place, seed, "bucket"), place)
    return dealt.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= take).drop("_rn", "_at")


def min_feasible_cap(counts: DataFrame, target: int, n: str = "n") -> DataFrame:
    """One row (cap): the least C with sum(min(n, C)) >= target; the greatest n if the total is short, 0 for none.

    The sum is linear between two neighbouring counts, so it is enough to look
    at each distinct count once, however large the groups are.
    """
    sizes = counts.groupBy(F.col(n).cast("bigint").alias("n")).agg(F.count("*").alias("g"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = sizes.select(
        "n", F.coalesce(F.lag("n").over(Window.orderBy("n")), F.lit(0).cast("bigint")).alias("prev"),
        (F.sum(F.col("n") * F.col("g")).over(upto) - F.col("n") * F.col("g")).alias("below"),
        (F.sum("g").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))).alias("at_least"),
    )
    need = F.ceil((F.lit(target) - F.col("below")) / F.col("at_least"))
    fits = line.withColumn("cap", F.greatest(need, F.col("prev") + 1)).where(F.col("cap") <= F.col("n"))
    least = fits.agg(F.min("cap")).scalar()
    return line.agg(F.max("n").alias("most")).select(F.coalesce(least, F.col("most"), F.lit(0)).cast("bigint").alias("cap"))


def site_cap(counts: DataFrame, target: int, share: float = 0.05) -> DataFrame:
    """One row (cap): ``share`` of the target where that many rows can be had, else the least feasible cap."""
    soft = max(1, int(target * share))
    reach = counts.agg(F.coalesce(F.sum(F.least(F.col("n"), F.lit(soft))), F.lit(0)).alias("reach"))
    hard = min_feasible_cap(counts, target).scalar()
    return reach.select(F.when(F.col("reach") >= target, F.lit(soft)).otherwise(hard).cast("bigint").alias("cap"))


def first_in_group(rows: DataFrame, group: str, key: Column, most: int, seed: str) -> DataFrame:
    """Up to ``most`` rows of every group in a seeded order, with their place ``_rn``; the limit is taken before the shuffle as well, so a hot group shrinks to it."""
    inside = Window.partitionBy(group).orderBy(seeded(key, seed), key)
    return rows.withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") <= most)


def prefix(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows in an order; each task keeps no more than that many."""
    return rows.orderBy(*order).limit(most)


def capped_by_group(rows: DataFrame, group: str, key: str, target: int, seed: str) -> DataFrame:
    """``target`` rows dealt round robin from the groups, none giving more than the cap that reaches the target."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    # no group gives more than target rows: this static limit is taken before the shuffle
    capped = first_in_group(rows, group, F.col(key), target, seed).where(F.col("_rn") <= site_cap(counts, target).scalar())
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return capped.orderBy("_rn", seeded(name, seed, "site"), name).limit(target).drop("_rn")


def hold_out(rows: DataFrame, group: str, seed: str, share: float = 0.10) -> DataFrame:
    """(group, split): a seeded ``share`` of the groups, at least one, is ``val``, the rest ``train``.

    Halves are rounded to even.  Groups are counted and ordered, rows are not
    moved; null groups take part as one.
    """
    names = rows.select(F.coalesce(F.col(group), F.lit("")).alias(group)).distinct()
    placed = position(names, [seeded(F.col(group), seed), group])
    held = placed.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share)).cast("int"))).scalar()
    return placed.select(group, F.when(F.col("pos") < held, "val").otherwise("train").alias("split"))


def with_split(rows: DataFrame, group: str, held: DataFrame) -> DataFrame:
    """``rows`` with the split of their group."""
    named = held.select(F.col(group).alias("_g"), F.col("split").alias("_split"))
    joined = rows.join(broadcast_if_small(named), F.coalesce(F.col(group), F.lit("")) == F.col("_g"), "left")
    return joined.withColumn("split", F.col("_split")).drop("_g", "_split")


def shared_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """The groups that occur on both sides (none, if a hold-out is sound)."""
    return a.select(group).intersect(b.select(group))


def shuffled(rows: DataFrame, key: Column, seed: str) -> DataFrame:
    """All rows in a seeded order."""
    return rows.orderBy(seeded(key, seed), key)


def mixture(parts: list[tuple[DataFrame, int]], key: str, seed: str) -> DataFrame:
    """The parts, each as often as given, in one seeded order; ``copy`` tells repeats apart."""
    out = None
    for part, times in parts:
        many = part.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        out = many if out is None else out.unionByName(many)
    return shuffled(out, F.concat_ws(":", key, "copy"), seed)


def examples(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows picked by seeded order."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)
