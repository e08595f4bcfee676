"""Spark session for local runs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", name: str = "lakewright") -> SparkSession:
    """A local session with the settings that the operators are tested under.

    On a cluster, use the session that the platform gives: no operator depends
    on a setting made here, apart from the UTC session time zone.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='lakewright-')}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the session's checkpoint folder; a local session without one gets a folder of its own."""
    _checkpoint_dir(df.sparkSession)
    # The shuffle files of the plan go as soon as it has been written.
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()


class Written:
    """``df``, computed and written as compressed Parquet into the checkpoint folder; ``drop`` takes it away, else it goes with the JVM."""

    def __init__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        at = f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        with _cleaned(spark):
            df.write.option("compression", "zstd").parquet(at)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        self._store = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._store.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        self._store.delete(self._path, True)
