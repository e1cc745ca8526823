"""Training records from step rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.schema import OPERATIONS
from stepmill.functions.text import ELEMENT_INSTRUCTIONS, OPERATION_INSTRUCTIONS, option_label, training_state


def _question(instructions: str, options: Column, label: Column) -> Column:
    empty = F.transform(options, lambda o: F.lit(None).cast("string"))
    return F.struct(F.lit("choice").alias("type"), F.lit(instructions).alias("instructions"), F.map_from_arrays(options, empty).alias("criteria"), label.alias("label"))


def training_records(rows: DataFrame) -> DataFrame:
    """(state, questions, _meta) of every row with a gold element.

    Repeated option labels and unknown operations are errors; the checks sit
    in the label columns, so they run whenever the record is read.
    """
    labels = F.transform("candidates", option_label)
    known = F.col("operation").isin(*OPERATIONS)
    kept = rows.where("gold_idx is not null").withColumn("labels", labels)
    gold = F.get("labels", F.col("gold_idx"))
    element = F.when(F.size(F.array_distinct("labels")) == F.size("labels"), gold).otherwise(F.raise_error(F.concat(F.lit("option labels are not unique: "), F.coalesce("id", F.lit("null")))))
    operation = F.when(known, F.col("operation")).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("null")))))
    ops = F.array(*[F.lit(o) for o in OPERATIONS])
    return kept.select(
        training_state(F.col("goal"), F.col("previous_actions"), F.col("candidates")).alias("state"),
        F.struct(_question(ELEMENT_INSTRUCTIONS, F.array_distinct("labels"), element).alias("element"), _question(OPERATION_INSTRUCTIONS, ops, operation).alias("operation")).alias("questions"),
        F.struct("id").alias("_meta"),
    )


def decision_requests(rows: DataFrame, variant: str = "a") -> DataFrame:
    """(id, request): the JSON a decision service is asked with; labels take no part."""
    from stepmill.functions.text import phrasing, render_state

    state = render_state(F.col("goal"), F.col("website"), F.col("domain"), F.col("previous_actions"), F.col("candidates"))
    options = F.transform("candidates", lambda c: c.getField("idx").cast("string"))
    element = F.struct(F.lit("choice").alias("type"), phrasing(variant).alias("instructions"), options.alias("options"))
    operation = F.struct(F.lit("choice").alias("type"), F.lit(OPERATION_INSTRUCTIONS).alias("instructions"), F.array(*[F.lit(o) for o in OPERATIONS]).alias("options"))
    body = F.struct(state.alias("state"), F.struct(element.alias("element"), operation.alias("operation")).alias("questions"))
    return rows.select("id", F.to_json(body).alias("request"))
