"""Readers and writers of the file forms."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepmill.functions.schema import EVAL_ROW, PREDICTION, RANK, TASK, TRAINING_RECORD
from stepmill.functions.text import ascii_json
from stepmill.session import writing


def read_rows(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """Eval rows from JSON lines; blank lines are skipped, candidates sorted by ``idx``.

    With ``check`` a row without exactly 10 candidates is an error as soon as
    its candidates are read, and a file without rows is an error at once.
    """
    rows = spark.read.schema(EVAL_ROW).json(path)
    if not check:
        return rows
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    placed = F.array_sort("candidates", lambda a, b: a.getField("idx") - b.getField("idx"))
    wrong = F.raise_error(F.concat(F.lit("not 10 candidates: "), F.coalesce("id", F.lit("null"))))
    return rows.withColumn("candidates", F.when(F.coalesce(F.size("candidates"), F.lit(-1)) == 10, placed).otherwise(wrong))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_RECORD).json(path)


def shard_paths(prefix: str, count: int) -> list[str]:
    """``{prefix}/{prefix}_{i}.json`` for i below count; the last part of the prefix names the files."""
    name = prefix.rstrip("/").rsplit("/", 1)[-1]
    return [f"{prefix.rstrip('/')}/{name}_{i}.json" for i in range(count)]


def read_tasks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tasks from staged shards, each a JSON array; one file is one task's work, so shards should be many."""
    return spark.read.schema(TASK).option("multiLine", True).json(paths)


def unpack_zip(spark: SparkSession, archive: str, member: str, folder: str, password: str | None = None, piece: int = 1 << 20) -> str:
    """Stage one member of a (password-protected) ZIP for ``read_tasks`` below ``folder``, on any file system Spark knows; gives the file's path.

    The member streams through the driver in pieces and is never held whole.
    """
    import zipfile

    path = f"{folder.rstrip('/')}/{member}"
    with zipfile.ZipFile(archive) as z, z.open(member, pwd=password.encode() if password else None) as source, writing(spark, path) as write:
        while data := source.read(piece):
            write(data)
    return path


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """The long rank table (step_key, backend_node_id, rank)."""
    return spark.read.schema(RANK).parquet(path)


def read_rank_map(spark: SparkSession, path: str) -> DataFrame:
    """The long rank table out of the nested form, JSON objects {"ranks": {step_key: {backend_node_id: rank}}}."""
    nested = spark.read.schema("ranks map<string,map<string,bigint>>").option("multiLine", True).json(path)
    steps = nested.select(F.explode("ranks").alias("step_key", "of_step"))
    return steps.select("step_key", F.explode("of_step").alias("backend_node_id", "rank"))


def read_parts(spark: SparkSession, folder: str, table: str, parts: list[int] | None = None) -> DataFrame:
    """A table stored in numbered part files; only the parts asked for are listed."""
    if parts is None:
        return spark.read.parquet(f"{folder}/{table}*")
    return spark.read.parquet(*[f"{folder}/{table}_{p}.parquet" for p in parts])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(html_dom_url, html): snapshots staged as files, named by their path below ``folder``; ``html`` holds the bytes, which the parser decodes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("html_dom_url"), F.col("content").alias("html"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): raw lines, blank ones dropped."""
    return spark.read.text(path).where(F.trim("value") != "")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_ascii_json(df: DataFrame, path: str) -> None:
    """JSON lines in ASCII alone, so that no reader takes a line separator in a text for a line end."""
    df.select(ascii_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def round_trip(rows: DataFrame) -> DataFrame:
    """(n, changed): how many rows there are, and how many do not come back the same from ``write_ascii_json``'s lines."""
    line = ascii_json(F.struct(*[F.col(c) for c in rows.columns]))
    again = rows.select(line.alias("line")).withColumn("back", F.from_json("line", rows.schema))
    return again.agg(F.count("*").alias("n"), F.count_if(~F.col("line").eqNullSafe(ascii_json(F.col("back")))).alias("changed"))


RUN = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in ("adapter", "dataset_name", "dataset_path")],
        T.StructField("n", T.LongType()),
        *[T.StructField(k, T.StringType()) for k in ("render_mode", "phrasing", "git_commit", "generated_at")],
        T.StructField("wall_s", T.DoubleType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
        T.StructField("usage_total", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def write_run(path: str, adapter: str, dataset_name: str, metrics: DataFrame, usage: dict | None = None, **about) -> dict:
    """The payload of one run: its settings and metric blocks (a few rows) in one JSON file, on any file system Spark knows; gives the payload."""
    blocks = {"overall" if r.scope == "overall" else r.split: {k: v for k, v in r.asDict().items() if k not in ("scope", "split", "adapter", "dataset_name")} for r in metrics.collect()}
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = {"adapter": adapter, "dataset_name": dataset_name, "generated_at": now, "n": blocks.get("overall", {}).get("n", 0), "metrics": blocks, "usage_total": usage or None} | about
    with writing(metrics.sparkSession, path) as write:
        write(json.dumps(run).encode("ascii"))
    return run


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All run payloads of a folder; unreadable files and those without adapter or dataset are ignored, of the same two the last file by name counts."""
    raw = spark.read.schema(RUN).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*.json").withColumn("_file", F.input_file_name())
    kept = raw.where("adapter is not null and dataset_name is not null")
    return kept.groupBy("adapter", "dataset_name").agg(F.max_by(F.struct(*[c for c in raw.columns if c not in ("adapter", "dataset_name", "_file")]), "_file").alias("r")).select("adapter", "dataset_name", "r.*")


def run_blocks(runs: DataFrame) -> DataFrame:
    """The metric blocks of run payloads as rows, as ``metrics`` gives them."""
    each = runs.select("adapter", "dataset_name", F.explode("metrics").alias("split", "m"))
    scope = F.when(F.col("split") == "overall", "overall").otherwise("split")
    fields = ("element_acc", "operation_acc", "step_success", "brier", "latency_mean_ms", "latency_p50_ms")
    return each.select("adapter", "dataset_name", scope.alias("scope"), F.when(scope == "split", F.col("split")).alias("split"), F.try_element_at("m", F.lit("n")).cast("bigint").alias("n"), *[F.try_element_at("m", F.lit(f)).alias(f) for f in fields])
