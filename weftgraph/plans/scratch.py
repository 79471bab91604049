"""Written intermediate tables: they cut lineage and outlive lost executors.

Every table goes to a run folder under the shared folder that the session names in
``spark.checkpoint.dir``.  Only where the session names none (tests on one machine)
is a folder of our own set.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; set to a temporary one only if unset and all runs
    on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _drop_all(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)
    except Exception:  # the JVM may have gone already at exit
        pass


class Scratch:
    """One run's folder of written tables; what is left goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop_all, spark, self.root)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def write(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Writes df and returns the written table; its path is kept in ``scratch_path``."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def delete(self, path: str) -> None:
        _delete(self.spark, path)

    def exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def release(self) -> None:
        """Lets shuffle files of plans that nothing refers to any more go now; otherwise
        they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep_only(self, *kept: DataFrame) -> None:
        """Deletes all that was written so far but these tables."""
        names = {df.scratch_path.rpartition("/")[2] for df in kept}
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        where = root.getFileSystem(conf)
        for entry in where.listStatus(root) if where.exists(root) else []:
            if entry.getPath().getName() not in names:
                where.delete(entry.getPath(), True)

    def drop(self, df: DataFrame) -> None:
        """Deletes a written table that no later plan reads."""
        if path := getattr(df, "scratch_path", None):
            _delete(self.spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, its lineage cut and its partitioning kept."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def uncut(df: DataFrame) -> None:
    """Deletes the files of a table that cut() made and no later plan reads."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _delete(df.sparkSession, file.get())


@contextlib.contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are run as they are: one job each, not one a shuffle, and tables
    that cut() makes keep their partitioning, which adaptive plans lose."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
