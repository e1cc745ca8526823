"""Explicit schemas of all inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: Operations a step can take, in their fixed order.
OPERATIONS = ("CLICK", "TYPE", "SELECT")
#: Keys of a candidate's attributes, in their fixed order.
ATTRS = ("id", "aria-label", "placeholder", "name", "type", "href")

_S = T.StringType()
ATTRS_TYPE = T.StructType([T.StructField(k, _S) for k in ATTRS])
CANDIDATE = T.StructType(
    [T.StructField("idx", T.IntegerType()), T.StructField("tag", _S), T.StructField("role", _S), T.StructField("text", _S), T.StructField("attrs", ATTRS_TYPE)]
)
EVAL_ROW = T.StructType(
    [
        *[T.StructField(k, _S) for k in ("id", "split", "website", "domain", "goal")],
        T.StructField("previous_actions", T.ArrayType(_S)),
        T.StructField("candidates", T.ArrayType(CANDIDATE)),
        T.StructField("gold_idx", T.IntegerType()),
        T.StructField("operation", _S),
        T.StructField("value", _S),
    ]
)
#: Columns that no predictor may see.
LABELS = ("gold_idx", "operation", "value")
PREDICTION = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("element_probs", T.ArrayType(T.DoubleType())),
        T.StructField("operation_probs", T.MapType(_S, T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("usage", T.MapType(_S, T.DoubleType())),
    ]
)
_RAW = T.StructType([T.StructField("backend_node_id", _S), T.StructField("is_original_target", T.BooleanType())])
ACTION = T.StructType(
    [
        T.StructField("action_uid", _S),
        T.StructField("cleaned_html", _S),
        T.StructField("operation", T.StructType([T.StructField("op", _S), T.StructField("value", _S)])),
        T.StructField("pos_candidates", T.ArrayType(_RAW)),
        T.StructField("neg_candidates", T.ArrayType(_RAW)),
    ]
)
TASK = T.StructType(
    [
        *[T.StructField(k, _S) for k in ("annotation_id", "website", "domain", "confirmed_task")],
        T.StructField("action_reprs", T.ArrayType(_S)),
        T.StructField("actions", T.ArrayType(ACTION)),
    ]
)
RANK = T.StructType([T.StructField("step_key", _S), T.StructField("backend_node_id", _S), T.StructField("rank", T.LongType())])
_QUESTION = T.StructType([T.StructField("type", _S), T.StructField("instructions", _S), T.StructField("criteria", T.MapType(_S, _S)), T.StructField("label", _S)])
TRAINING_RECORD = T.StructType(
    [
        T.StructField("state", _S),
        T.StructField("questions", T.StructType([T.StructField("element", _QUESTION), T.StructField("operation", _QUESTION)])),
        T.StructField("_meta", T.StructType([T.StructField("id", _S)])),
    ]
)
