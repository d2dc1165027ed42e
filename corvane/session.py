"""Session construction and storage of intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "corvane", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session without one (tests) gets its own.

    A folder of one machine is no place for what executors write: without a named folder a cluster's session fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"corvane-checkpoints-{os.getpid()}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Stored:
    """Intermediate tables written to the shared folder, so that lineage ends there and a lost executor costs no recomputation.

    Results may still read them, so they stay until ``close``, or ``close_all`` at the end of the process at the latest.
    """

    made_here: list[Stored] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if not Stored.made_here:
            atexit.unregister(Stored.close_all)
            atexit.register(Stored.close_all)
        Stored.made_here.append(self)
        self.base = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, *bucket: str, group_rows: int | None = None) -> tuple[DataFrame, str]:
        """Write df as Parquet and return (it read back, its path).

        Rows of megabytes need ``group_rows``: writers hold at least a hundred rows before they look at their size, and readers
        decode up to 4,096 rows at once, but neither goes beyond a row group.
        """
        path = f"{self.base}/{self.made}"
        self.made += 1
        writer = df.write.mode("overwrite")
        if group_rows:
            writer = writer.option("parquet.block.row.count.limit", group_rows)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Remove all of its tables: nothing that reads them may run afterwards."""
        try:
            self.drop(self.base)
        except Exception:  # the session is gone: what lies on this machine can still be removed
            shutil.rmtree(self.base.removeprefix("file:").replace("///", "/"), ignore_errors=True)
        if self in Stored.made_here:
            Stored.made_here.remove(self)

    @classmethod
    def close_all(cls) -> None:
        for stored in list(cls.made_here):
            stored.close()
