"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Room for regular expressions on very long lines.
        "spark.executor.extraJavaOptions": "-Xss8m",
        "spark.driver.extraJavaOptions": "-Xss8m",
        # Call-site capture costs more than building the expressions of a rule pack.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; in a local session that names none, one under /tmp/checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return "file:///tmp/checkpoints"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of rows that go to a Python worker at once; texts take several times that in the worker and outside the heap.
BATCH_BYTES = 8 * 1024 * 1024


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES at most while a step runs; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    size = before.removesuffix("b")
    if size.isdigit() and 0 < int(size) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: With this setting Spark removes an execution's shuffle files when it ends, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """The shuffle files of a step go as soon as its table stands: nothing reads them again."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


class Steps:
    """Tables written between the steps of one job: columnar, in the shared folder, gone with the session.

    A step that reads such a table depends on files every executor can open, so a lost executor costs a re-read
    and no earlier step. `drop` removes a table as soon as no later step reads it.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{job}-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        with _small_batches(self.spark), _shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """Drop all tables now, not when the session ends; for jobs that are done many times in one session."""
        atexit.unregister(self._leave)
        _delete(self.spark, self.folder)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.folder}/{name}")

    def _leave(self) -> None:
        try:
            _delete(self.spark, self.folder)
        except Exception:  # noqa: BLE001  the session has ended first; its folder is left to the cluster's own clean-up
            pass


def cut_lineage(df: DataFrame, name: str = "rows") -> DataFrame:
    """Keep the rows in the shared folder: later branches read them, not the text again."""
    return Steps(df.sparkSession, "scan").keep(df, name)
