"""Session helpers: the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset in a local run (tests) a local
    folder is made once per session and set as the checkpoint folder; on a
    cluster an unset one is an error, since its machines share no such folder.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    sc = spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stepmill-shared-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def table_folder(spark: SparkSession, name: str) -> str:
    """A fresh place for a written table below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_folder(spark: SparkSession, name: str, key: str) -> str:
    """The place below the shared folder that always belongs to ``name`` and ``key``, in later sessions too."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"


@contextlib.contextmanager
def writing(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """A function that appends bytes to a new file at ``path``, on whichever file system the path belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        yield lambda data: out.write(bytearray(data))
    finally:
        out.close()


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


def fits(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> bool:
    """True if ``df`` has at most ``rows`` rows whose values, written as text, have at most ``size`` characters in all."""
    text = F.concat_ws("", *[F.to_json(F.struct(c)) if "<" in t else F.col(f"`{c}`").cast("string") for c, t in df.dtypes])
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    return got.n <= rows and (got.chars or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it ``fits``, else as it is.

    The hint is given only after counting rows and characters, so a table that
    has outgrown the bound is joined by shuffle.
    """
    return F.broadcast(df) if fits(df, rows, size) else df


def input_bytes(df: DataFrame) -> int:
    """The size of everything a plan reads, as Spark knows it without running it; written intermediate tables count as boundless."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy for each row.

    Small inputs often come in one file; large ones have many partitions and
    stay as they are, so nothing is shuffled there.  Meant for plans without a
    shuffle so far: counting the partitions of others would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_stepmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="stepmill-code-"), "stepmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("stepmill", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._stepmill_shipped = True
