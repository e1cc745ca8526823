"""Predictors: a closed registry, labels hidden from all of them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepmill.functions.schema import LABELS, OPERATIONS, PREDICTION
from stepmill.functions.scores import bind, first_argmax, softmax, total, uniform
from stepmill.functions.text import candidate_tokens, overlap, query_tokens

#: A predictor takes one row (a dict without labels) and gives
#: {"element_probs": [10], "operation_probs": {...}, optional "latency_ms", "usage"}.
#: One with a method ``predict_batch`` is given all rows of an Arrow batch at once instead.
Predictor = Callable[[dict], dict]

_FACTORIES: dict[str, Callable[[], Predictor]] = {}
NATIVE = ("first", "random", "lexical")


def hide_labels(rows: DataFrame) -> DataFrame:
    """``rows`` as a predictor may see them."""
    return rows.drop(*LABELS)


def register(name: str, factory: Callable[[], Predictor]) -> None:
    """Add an external predictor; ``factory`` runs once for each partition (model load, connection, warm-up)."""
    if name in NATIVE:
        raise ValueError(f"{name} is built in")
    _FACTORIES[name] = factory


def _operations(values: list[Column]) -> Column:
    return F.create_map(*[x for op, v in zip(OPERATIONS, values, strict=True) for x in (F.lit(op), v)])


def _struct(adapter: str, element: Column, operation: Column) -> Column:
    return F.struct(F.lit(adapter).alias("adapter"), element.alias("element_probs"), operation.alias("operation_probs"))


def _first() -> Column:
    return _struct("first", F.transform("candidates", lambda c, i: F.when(i == 0, 1.0).otherwise(0.0)), _operations([F.lit(1.0), F.lit(0.0), F.lit(0.0)]))


def _random(seed: str = "random") -> Column:
    def scaled(values: Column) -> Column:
        return bind(values, lambda v: bind(total(v), lambda whole: F.transform(v, lambda x: x / whole)))

    element = scaled(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: uniform(F.concat_ws(":", F.col("id"), i), seed)))
    ops = scaled(F.array(*[uniform(F.concat_ws(":", F.col("id"), F.lit(op)), seed) for op in OPERATIONS]))
    return bind(ops, lambda o: _struct("random", element, _operations([F.get(o, F.lit(i)) for i in range(3)])))


def lexical_operation(cand: Column) -> Column:
    """The operation that tag and role of a candidate suggest."""
    tag, role = F.lower(F.coalesce(cand.getField("tag"), F.lit(""))), F.lower(F.coalesce(cand.getField("role"), F.lit("")))
    return F.when((tag == "select") | role.isin("combobox", "listbox"), "SELECT").when(tag.isin("input", "textarea") & ~role.isin("button", "checkbox", "radio", "link"), "TYPE").otherwise("CLICK")


def _lexical() -> Column:
    # the asked tokens, the scores and the best candidate are worked out once for each row
    asked = query_tokens(F.col("goal"), F.col("previous_actions"))
    shared = bind(asked, lambda q: F.transform("candidates", lambda c: overlap(q, candidate_tokens(c)).cast("double")))

    def answer(s: Column) -> Column:
        best = bind(F.get("candidates", first_argmax(s)), lexical_operation)
        return bind(best, lambda op: _struct("lexical", softmax(s), _operations([F.when(op == name, 0.7).otherwise(0.15) for name in OPERATIONS])))

    return bind(shared, answer)


def native(name: str) -> Column:
    """The prediction of a built-in predictor as one struct (adapter, element_probs, operation_probs), from the columns of a row alone.

    ``first``: all weight on the first candidate and on CLICK.  ``random``:
    uniform numbers seeded by the row's id, scaled to sum 1.  ``lexical``:
    softmax of the tokens each candidate shares with goal and last action; the
    operation from the best one's tag and role.
    """
    return {"first": _first, "random": _random, "lexical": _lexical}[name]()


def predict_native(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` once for each of the built-in predictors, with adapter, element_probs, operation_probs, latency_ms and usage.

    Everything a native predictor needs stands in the row, so nothing is
    joined back; candidates and texts are dropped before the rows multiply.
    """
    kept = [c for c in rows.columns if c not in ("candidates", "goal", "previous_actions", "domain")]
    each = rows.select(*kept, F.array(*[native(n) for n in names]).alias("_p")).select(*kept, F.explode("_p").alias("_p"))
    none = F.lit(None).cast("map<string,double>")
    return each.select(*kept, "_p.adapter", "_p.element_probs", "_p.operation_probs", F.lit(0.0).alias("latency_ms"), none.alias("usage"))


def predict(name: str, rows: DataFrame) -> DataFrame:
    """Predictions of the named predictor; ``rows`` may still carry labels, the predictor never gets them.

    External ones run in Arrow batches, one instance for each partition.  The
    latency is measured around the call unless the predictor reports its own.
    """
    seen = hide_labels(rows)
    if name in NATIVE:
        return predict_native(seen, name).select("id", "element_probs", "operation_probs", "latency_ms", "usage")
    if name not in _FACTORIES:
        raise KeyError(f"no predictor {name!r}; there are {sorted([*NATIVE, *_FACTORIES])}")
    factory = _FACTORIES[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = factory()
        many = one.predict_batch if hasattr(one, "predict_batch") else None
        for batch in batches:
            rows = batch.to_dict("records")
            began = time.perf_counter()
            if many:
                answers = many(rows)
                if len(answers) != len(rows):
                    raise ValueError(f"{name}: {len(answers)} predictions for {len(rows)} rows")
                spent = [(time.perf_counter() - began) * 1000 / max(1, len(rows))] * len(rows)
            else:
                answers, spent = [], []
                for row in rows:
                    began = time.perf_counter()
                    answers.append(one(row))
                    spent.append((time.perf_counter() - began) * 1000)
            out = [(r["id"], [float(p) for p in got["element_probs"]], dict(got["operation_probs"]), float(got.get("latency_ms", took)), got.get("usage")) for r, got, took in zip(rows, answers, spent, strict=True)]
            yield pd.DataFrame(out, columns=PREDICTION.names)

    return seen.mapInPandas(run, PREDICTION)


class Overloaded(Exception):
    """A service asks to be called again later."""


def retrying(call: Callable, tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again when it is ``Overloaded``, after a wait that doubles each time; the last refusal is raised."""

    def tried(*args, **kwargs):
        pause = wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(*args, **kwargs)
            except Overloaded:
                if not left:
                    raise
                sleep(pause)
                pause *= 2

    return tried


def order_ensemble(forward: DataFrame, backward: DataFrame, both_operations: bool = False) -> DataFrame:
    """Mean of two passes, the second over the reversed candidates, by real position.

    The operation comes from the forward pass unless ``both_operations``.
    """
    f = forward.select("id", F.col("element_probs").alias("f"), F.col("operation_probs").alias("fo"), F.col("latency_ms").alias("fl"))
    b = backward.select("id", F.reverse("element_probs").alias("b"), F.col("operation_probs").alias("bo"), F.col("latency_ms").alias("bl"))
    mean_op = _operations([(F.coalesce(F.try_element_at("fo", F.lit(o)), F.lit(0.0)) + F.coalesce(F.try_element_at("bo", F.lit(o)), F.lit(0.0))) / 2 for o in OPERATIONS])
    return f.join(b, "id").select("id", F.zip_with("f", "b", lambda x, y: (x + y) / 2).alias("element_probs"), (mean_op if both_operations else F.col("fo")).alias("operation_probs"), (F.col("fl") + F.col("bl")).alias("latency_ms"))


def reversed_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with their candidates in reversed order, renumbered."""
    return rows.withColumn("candidates", F.transform(F.reverse("candidates"), lambda c, i: c.withField("idx", i.cast("int"))))


def decode_answers(answer: Column, keys: Column) -> Column:
    """Element probabilities out of a decoded answer map (option label to probability), in the order of ``keys``."""
    raw = F.transform(keys, lambda k: F.coalesce(F.try_element_at(answer, k), F.lit(0.0)))
    whole = total(raw)
    return F.when(whole > 0, F.transform(raw, lambda v: v / F.nullif(whole, F.lit(0.0)))).otherwise(raw)


def decode_response(response: Column, question: str, keys: Column) -> Column:
    """Probabilities in the order of ``keys`` out of a service's JSON text, whichever of its forms it takes.

    The answers stand under ``answers`` or at the top; under the question's
    name there is a map of probabilities (itself, or as ``probabilities``,
    ``probs`` or ``distribution``), or only the chosen label (as ``label`` or
    ``choice``, or a plain text), which then has all weight.  What cannot be
    read gives zeros.
    """
    path = [F.get_json_object(response, f"$.answers.{question}"), F.get_json_object(response, f"$.{question}")]
    body = F.coalesce(*path)
    as_map = lambda c: F.from_json(c, "map<string,double>")
    inner = [as_map(F.get_json_object(body, f"$.{k}")) for k in ("probabilities", "probs", "distribution")]
    label = F.coalesce(F.get_json_object(body, "$.label"), F.get_json_object(body, "$.choice"), F.when(~body.startswith("{"), body))
    known = lambda m: F.when(F.exists(keys, lambda k: F.try_element_at(m, k).isNotNull()), m)
    maps = F.coalesce(*[known(m) for m in (*inner, as_map(body))])
    return F.when(maps.isNotNull(), decode_answers(maps, keys)).otherwise(F.transform(keys, lambda k: F.when(k.eqNullSafe(label), 1.0).otherwise(0.0)))


def letter_probabilities(logits: Column, options: int) -> Column:
    """Softmax over the scores of the letter tokens A, B, C... of the options; a letter without a score counts as the least there is."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(options)])
    found = F.transform(letters, lambda k: F.try_element_at(logits, k))
    return bind(F.array_min(found), lambda least: softmax(F.transform(found, lambda x: F.coalesce(x, least, F.lit(0.0)))))
