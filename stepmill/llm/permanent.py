"""Problem 5: a sample that stays the same as data grows.

Every identifier gets a permanent random number when it is first seen: new
deliveries are anti-joined with the numbers already stored and only new ids
are inserted.  The sample is always the ids under a threshold that never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepmill.llm.quota import uniform
from stepmill.session import table_folder

SCHEMA = "id string, u double, first_load int"


class PermanentNumbers:
    """A growing table (id, u, first_load) in a shared folder.

    Each insert adds one folder ``load=k-n``; written folders never change, so
    a lost executor or a repeated insert leaves the numbers as they were.  All
    state lies in the folder: a store opened on it later, in another process
    too, goes on with its numbers and its highest threshold.  Folders of
    inserts that did not finish are passed over.  One process may insert at a
    time.  Without ``folder`` the store is a new one of its own.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, seed: str = "permanent") -> None:
        self.spark, self.seed = spark, seed
        self.folder = (folder or table_folder(spark, "permanent-numbers")).rstrip("/")

    def _fs(self, *names: str):
        """The file system of the store and the path of a folder or file in it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *below: str) -> list[str]:
        fs, path = self._fs(*below)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _begun(self) -> dict[int, str]:
        """The folders of all inserts by number, finished or not."""
        return {int(n.rsplit("-", 1)[1]): n for n in self._names() if n.startswith("load=")}

    @property
    def parts(self) -> list[str]:
        """The folders of the finished inserts, in order."""
        return [f"{self.folder}/{n}" for _, n in sorted(self._begun().items()) if "_SUCCESS" in self._names(n)]

    @property
    def threshold(self) -> float:
        """The highest threshold ever asked for, 0 at first."""
        return max(map(float, self._names("thresholds")), default=0.0)

    def numbers(self) -> DataFrame:
        """All ids seen so far with their numbers."""
        parts = self.parts
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*parts)

    def insert(self, ids: DataFrame, load: int) -> None:
        """Numbers for the ids of one delivery that were never seen; null ids get none."""
        self.insert_all(ids.select("id", F.lit(load).alias("load_no")), str(load))

    def insert_all(self, rows: DataFrame, name: str = "all") -> None:
        """Numbers for the ids of several deliveries (id, load_no) in one pass, as if each were inserted in its turn.

        An id's first delivery is the least number it came with; ids already
        stored keep theirs.  An insert without a new id leaves no folder.
        """
        new = rows.where("id is not null").groupBy("id").agg(F.min("load_no").cast("int").alias("first_load"))
        if self.parts:
            new = new.join(self.numbers().select("id"), "id", "left_anti")
        part = f"load={name}-{max(self._begun(), default=-1) + 1}"
        new.select("id", uniform(F.col("id"), self.seed).alias("u"), "first_load").write.mode("error").parquet(f"{self.folder}/{part}")
        if self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{part}").isEmpty():
            fs, path = self._fs(part)
            fs.delete(path, True)

    def raise_to(self, threshold: float) -> None:
        """Keep ``threshold`` as the highest; one below an earlier one is refused."""
        highest = self.threshold
        if threshold < highest:
            raise ValueError(f"the threshold may not fall: {threshold} after {highest}")
        if threshold > highest:
            fs, path = self._fs("thresholds", repr(float(threshold)))
            fs.create(path, True).close()

    def select(self, threshold: float) -> DataFrame:
        """(id, u, first_load) of the sample; a threshold below an earlier one is refused."""
        self.raise_to(threshold)
        return self.numbers().where(F.col("u") < F.lit(threshold))


def _filled(rows: DataFrame, seed: str, folder: str | None) -> PermanentNumbers:
    """The store in ``folder`` after all deliveries of ``rows`` have been inserted, by one pass over them."""
    store = PermanentNumbers(rows.sparkSession, folder, seed)
    store.insert_all(rows.select("id", F.coalesce("load_no", F.lit(0)).alias("load_no")))
    return store


def stable_sample(rows: DataFrame, share: float = 0.2, seed: str = "permanent", folder: str | None = None) -> DataFrame:
    """(id, u, first_load) of the sample after all deliveries (``load_no``) have been inserted in turn.

    Rows without a delivery number come with delivery 0.  With ``folder`` the
    numbers are kept there: ids of earlier calls stay in the sample, so
    ``rows`` may hold the new deliveries alone.
    """
    return _filled(rows, seed, folder).select(share)


def sample_history(rows: DataFrame, share: float = 0.2, seed: str = "permanent", folder: str | None = None) -> DataFrame:
    """(load_no, new_ids, new_chosen, ids, chosen): how the sample grows with the deliveries; chosen never shrinks.

    ``folder`` as in ``stable_sample``.
    """
    store = _filled(rows, seed, folder)
    store.raise_to(share)
    per = store.numbers().groupBy("first_load").agg(F.count("*").alias("new_ids"), F.count_if(F.col("u") < share).alias("new_chosen"))
    upto = Window.orderBy("first_load").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(F.col("first_load").alias("load_no"), "new_ids", "new_chosen", F.sum("new_ids").over(upto).alias("ids"), F.sum("new_chosen").over(upto).alias("chosen"))
