"""Problem 3: splits that keep related records together.

Records (ids), tasks and sites form a graph.  Components come from minimum
labels passed back and forth between sites and tasks until nothing changes;
whole components are then dealt to the splits, the large ones one by one
against the label mix still wanted, the many small ones along a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.operators.ranking import running_sum
from stepmill.session import broadcast_if_small, cut

_BLANKS = r"(?U)^\s+|\s+$"


def site_key(website: Column) -> Column:
    """Null for null and blank values, else the site without case, outer blanks and one leading ``www.``."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(website, _BLANKS, "")), r"^www\.", "")
    plain = F.regexp_replace(plain, _BLANKS, "")
    return F.when(plain != "", plain)


def entity_edges(rows: DataFrame) -> DataFrame:
    """Distinct (task, site) of the rows; rows without a site or a task tie nothing.

    Pre-aggregated before anything else: a site that holds a third of all rows
    shrinks to one edge for each of its tasks.
    """
    return rows.select(F.col("_annotation_id").alias("task"), site_key(F.col("website")).alias("site")).where("task is not null and site is not null").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(site, label) with one label, the least site, for each component of (task, site).

    Minimum labels travel site -> task -> site; after each step a label is
    replaced by its own label, so chains shorten by half.  Only tasks with two
    sites or more tie sites, so the iteration runs on these alone, until no
    label changes: labels only fall, so it ends whatever the graph.  Each round
    is written to the shared folder, which cuts the lineage.
    """
    sites = edges.select("site").distinct()
    tying = edges.groupBy("task").agg(F.count("*").alias("n")).where("n > 1").select("task")
    links = cut(edges.join(tying, "task"))
    labels = cut(links.select("site").distinct().withColumn("label", F.col("site")))
    while True:
        tasks = links.join(labels, "site").groupBy("task").agg(F.min("label").alias("low"))
        seen = links.join(tasks, "task").groupBy("site").agg(F.min("low").alias("low"))
        step = labels.join(seen, "site").select("site", "label", F.least("label", "low").alias("low"))
        jump = step.select(F.col("site").alias("low"), F.col("low").alias("lower"))
        new = cut(step.join(jump, "low", "left").select("site", F.coalesce(F.least("low", "lower"), "low").alias("new"), "label"))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("site", F.col("new").alias("label"))
        if not changed:
            break
    return sites.join(labels, "site", "left").select("site", F.coalesce("label", "site").alias("label"))


def site_classes(rows: DataFrame) -> DataFrame:
    """(website, label): every distinct website value with the least site of its component; the form without pairs."""
    labels = connect(cut(entity_edges(rows)))
    values = rows.select("website").distinct().withColumn("site", site_key(F.col("website"))).where("site is not null")
    return values.join(labels, "site", "left").select("website", F.coalesce("label", "site").alias("label"))


def tied_sites(rows: DataFrame) -> DataFrame:
    """(website_a, website_b): all pairs of different website values that must share a split.

    Pairs are made only of the distinct values of one component, which the
    result asks for; rows never meet in pairs.  ``site_classes`` says the same
    in one row for each value.
    """
    placed = cut(site_classes(rows))
    a = placed.select("label", F.col("website").alias("website_a"))
    b = placed.select("label", F.col("website").alias("website_b"))
    return a.join(b, "label").where(F.col("website_a") < F.col("website_b")).select("website_a", "website_b")


def record_groups(rows: DataFrame) -> DataFrame:
    """(id, grp, label): the component of every distinct id, and its stratification label.

    A record without site and task forms its own group; one with a task only
    goes with the task.  Copies of an id in several groups join these groups.
    """
    base = rows.select("id", F.col("_annotation_id").alias("task"), site_key(F.col("website")).alias("site"), F.col("operation").alias("label")).where("id is not null")
    edges = cut(base.where("task is not null and site is not null").select("task", "site").distinct())
    labels = connect(edges)
    by_task = edges.join(broadcast_if_small(labels), "site").groupBy("task").agg(F.min("label").alias("task_grp"))
    by_site = labels.select("site", F.col("label").alias("site_grp"))
    # the hot side is the record side: where the others are few they are sent to it, else AQE splits hot keys
    named = base.join(broadcast_if_small(by_site), "site", "left").join(broadcast_if_small(by_task), "task", "left")
    key = F.coalesce(
        F.concat(F.lit("s:"), F.coalesce("site_grp", "task_grp")),
        F.concat(F.lit("s:"), F.col("site")),
        F.concat(F.lit("t:"), F.col("task")),
        F.concat(F.lit("r:"), F.col("id")),
    )
    placed = named.select("id", key.alias("grp"), "label")
    # one row for each id, aggregated before the shuffle; an id whose copies agree has one group
    one = cut(placed.groupBy("id").agg(F.min("grp").alias("grp"), F.max("grp").alias("other"), F.min("label").alias("label")))
    several = one.where("grp <> other").select("id")
    if several.isEmpty():
        return one.select("id", "grp", "label")
    # ids whose copies lie in several groups tie these groups: the same iteration over (id, group)
    ties = placed.join(broadcast_if_small(several), "id").select(F.col("id").alias("task"), F.col("grp").alias("site")).distinct()
    merged = connect(ties).select(F.col("site").alias("grp"), F.col("label").alias("to"))
    return one.join(broadcast_if_small(merged), "grp", "left").select("id", F.coalesce("to", "grp").alias("grp"), "label")


def assigned_ids(records: DataFrame, shares: DataFrame) -> DataFrame:
    """(id, split) of all records; the groups are sent to them where they are few, so that a hot group is not one task's work."""
    return records.join(broadcast_if_small(assign_splits(records, shares)), "grp").select("id", "split")


def assign_splits(records: DataFrame, shares: DataFrame, large: int = 2000, most_labels: int = 1000) -> DataFrame:
    """(grp, split) for ``records`` (id, grp, label) and ``shares`` (split, share_pct).

    Groups of at least 1/``large`` of all records (so at most ``large``, a
    bounded set) are placed on the driver, each where the summed squared
    deviation from the wanted counts per split and label grows least.  All
    smaller groups are ordered by main label and hash and laid along a running
    sum; the stretch of each label is cut in proportion to the room left for
    that label in each split, so that what the large groups lack or exceed of
    it is made up for; each cut errs by less than one small group.  A small
    group of several labels counts whole as its main one.  No records give no assignment; null labels are a
    label of their own; no shares are an error.
    """
    spark = records.sparkSession
    wanted = {r.split: float(r.share_pct) for r in shares.orderBy("split").collect() if r.split is not None}
    if not wanted:
        raise ValueError("no shares given")
    per = cut(records.groupBy("grp", "label").agg(F.count("*").alias("n")))
    kept = per.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels + 1).collect()
    if len(kept) > most_labels:
        plain = [r.label for r in kept[:most_labels] if r.label is not None]
        per = per.withColumn("label", F.when(F.col("label").isin(plain), F.col("label"))).groupBy("grp", "label").agg(F.sum("n").alias("n"))
    groups = cut(per.groupBy("grp").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("main")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    names = sorted(wanted)
    share = {s: wanted[s] / sum(wanted.values()) for s in names}
    bound = max(1, -(-total // large))
    big = groups.where(F.col("n") >= bound)
    mix: dict[str, dict] = {}
    for r in per.join(big.select("grp"), "grp").collect():
        mix.setdefault(r.grp, {})[r.label] = r.n
    all_labels = {r.label: r.n for r in per.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    target = {s: {lab: share[s] * n for lab, n in all_labels.items()} for s in names}
    have = {s: dict.fromkeys(all_labels, 0) for s in names}
    place: list[tuple[str, str]] = []
    for grp in sorted(mix, key=lambda g: (-sum(mix[g].values()), g)):
        def cost(s: str, g: str = grp) -> float:
            room = share[s] * total or 1e-9
            return sum((have[s][lab] + n - target[s][lab]) ** 2 - (have[s][lab] - target[s][lab]) ** 2 for lab, n in mix[g].items()) / room
        best = min(names, key=lambda s: (cost(s), s))
        place.append((grp, best))
        for lab, n in mix[grp].items():
            have[best][lab] += n
    placed = spark.createDataFrame(place or [("", names[0])], "grp string, split string")
    small = groups.where(F.col("n") < bound)
    # each label's stretch is cut by the room that the large groups left for this label in each split
    cuts = []
    for lab in all_labels:
        left = [max(0.0, target[s][lab] - have[s][lab]) for s in names]
        room = sum(left)
        cuts.append((lab, [sum(left[: i + 1]) / room if room else 0.0 for i in range(len(names) - 1)]))
    ends = spark.createDataFrame(cuts or [(None, [0.0] * (len(names) - 1))], "label string, ends array<double>")
    laid = running_sum(small.select("grp", "main", "n"), ["main", F.xxhash64("grp"), "grp"], "n")
    bounds = laid.groupBy("main").agg(F.min(F.col("upto") - F.col("n")).alias("lo"), F.max("upto").alias("hi"))
    bounds = bounds.join(F.broadcast(ends), bounds.main.eqNullSafe(ends.label)).drop("label").withColumnRenamed("main", "of")
    spot = laid.join(bounds, laid.main.eqNullSafe(bounds.of)).withColumn("at", (F.col("upto") - F.col("n") / 2 - F.col("lo")) / (F.col("hi") - F.col("lo")))
    choice = F.get(F.array(*map(F.lit, names)), F.size(F.filter("ends", lambda end: end <= F.col("at"))))
    dealt = spot.select("grp", choice.alias("split"))
    return placed.where("grp <> ''").unionAll(dealt)


def split_report(records: DataFrame, assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """(split, label, wanted_pct, n, pct_of_label): how near every split comes to its share, overall (label null) and by label."""
    each = records.join(assigned, "grp").groupBy("split", "label").agg(F.count("*").alias("n"))
    by_label = each.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("label")), 3)).withColumn("scope", F.lit("label"))
    whole = each.groupBy("split").agg(F.sum("n").alias("n"))
    whole = whole.select("split", F.lit(None).cast("string").alias("label"), "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 3).alias("pct"), F.lit("all").alias("scope"))
    return by_label.unionByName(whole).join(shares, "split", "left").select("scope", "split", "label", F.col("share_pct").alias("wanted_pct"), "n", "pct")
