"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepmill.llm import charforms, groups, leaks, overlap, packing, permanent, quota, sentences
from stepmill.session import cut, kept_folder


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not written in their ordinary characters."""
    return charforms.unusual(_texts(spark, folder)).select("id", "field", "idx")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return charforms.texts_of(_read(spark, folder, "eval_rows"), _read(spark, folder, "train_records"))


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """All texts in canonical form, with the kinds of what was replaced (0: none); repeated deliveries of the same text count once."""
    return charforms.unify(_texts(spark, folder)).select("id", "field", "idx", "canonical", "kinds").distinct()


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(field, texts, changed, forms): how many distinct spellings the goals and candidates have before and after."""
    texts = _texts(spark, folder).where("text is not null")
    each = texts.groupBy("field", "text").agg(F.count("*").alias("n")).withColumn("id", F.lit(None).cast("string")).withColumn("idx", F.lit(0))
    done = charforms.unify(each)
    return done.groupBy("field").agg(F.count("*").alias("spellings"), F.count_if(F.col("kinds") > 0).alias("unusual"), F.countDistinct("canonical").alias("forms"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and an evaluation task with the same request."""
    pairs = overlap.request_overlaps(_read(spark, folder, "eval_rows"))
    a, b = F.col("eval_task"), F.col("train_task")
    return pairs.select(F.least(a, b).alias("annotation_id_a"), F.greatest(a, b).alias("annotation_id_b")).distinct()


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per evaluation split and website."""
    return overlap.overlap_counts(_read(spark, folder, "eval_rows"))


def p2_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per task in a shared request class, with its number of partners."""
    return overlap.leaked_tasks(_read(spark, folder, "eval_rows"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of website values whose rows must share a split."""
    return groups.tied_sites(_read(spark, folder, "eval_rows"))


def p3_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Every website value with the least site of its component: the same ties without pairs."""
    return groups.site_classes(_read(spark, folder, "eval_rows"))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the assignment, counted: distinct ids, and ids, sites and tasks that lie in two splits."""
    rows = _read(spark, folder, "eval_rows").where("id is not null")
    split = cut(p3_assignment(spark, folder))
    placed = rows.select("id", groups.site_key(F.col("website")).alias("site"), F.col("_annotation_id").alias("task")).join(split, "id")
    whole = split.agg(F.lit("ids").alias("rule"), F.countDistinct("id").alias("n")).unionAll(split.agg(F.lit("rows"), F.count("*")))
    for key in ("id", "site", "task"):
        torn = placed.where(F.col(key).isNotNull()).groupBy(key).agg((F.min("split") != F.max("split")).alias("torn"))
        whole = whole.unionAll(torn.agg(F.lit(f"{key} in two splits"), F.count_if("torn")))
    return whole


def p3_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """(id, split) for every distinct id."""
    records = cut(groups.record_groups(_read(spark, folder, "eval_rows")))
    return groups.assigned_ids(records, _read(spark, folder, "split_shares"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """How near the splits come to their shares, overall and by operation."""
    shares = _read(spark, folder, "split_shares")
    records = cut(groups.record_groups(_read(spark, folder, "eval_rows")))
    return groups.split_report(records, groups.assign_splits(records, shares), shares)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the sample cannot meet."""
    return quota.unreached(_read(spark, folder, "eval_rows"), _read(spark, folder, "sample_targets"))


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of all target sets."""
    return quota.draw(_read(spark, folder, "eval_rows"), _read(spark, folder, "sample_targets"))[0]


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each target asked for and got."""
    sample, report = quota.draw(_read(spark, folder, "eval_rows"), _read(spark, folder, "sample_targets"))
    return quota.quota_report(cut(sample), report)


def _numbers_of(spark: SparkSession, folder: str) -> str:
    """The one store of permanent numbers of the tables in ``folder``."""
    return kept_folder(spark, "permanent-numbers", folder.rstrip("/"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the ids, the same on every run, keeping all ids of earlier deliveries and runs."""
    return permanent.stable_sample(_read(spark, folder, "eval_rows"), folder=_numbers_of(spark, folder))


def p5_history(spark: SparkSession, folder: str) -> DataFrame:
    """How that sample grows with the deliveries."""
    return permanent.sample_history(_read(spark, folder, "eval_rows"), folder=_numbers_of(spark, folder))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    windows = _read(spark, folder, "context_windows")
    sizes = cut(packing.token_counts(_read(spark, folder, "documents")))
    return packing.pack(packing.pieces(sizes, windows)), windows


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece, for every window."""
    return _packed(spark, folder)[0]


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers, counted for each window: documents placed, and faults of four kinds."""
    windows = _read(spark, folder, "context_windows")
    sizes = cut(packing.token_counts(_read(spark, folder, "documents")))
    packed = cut(packing.pack(packing.pieces(sizes, windows)))
    return packing.faults(packed, sizes, windows)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used against the least possible."""
    packed, windows = _packed(spark, folder)
    return packing.packing_report(packed, windows)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the held-out items they leak."""
    return p7_stretches(spark, folder).select("doc_id", "item_id").distinct()


def p7_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Where in its document each leaked stretch lies."""
    return leaks.find_leaks(_read(spark, folder, "documents"), _read(spark, folder, "heldout_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.split_sentences(_read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_canonical, p1_forms, p2_found, p2_counts, p2_tasks, p3_found, p3_sites, p3_assignment, p3_checks, p3_report,
        p4_found, p4_sample, p4_report, p5_sample, p5_history, p6_containers, p6_checks, p6_report, p7_found, p7_stretches, p8_found,
    )
}
