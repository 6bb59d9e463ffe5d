"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lodestar", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session (one
    machine, as in tests) may leave it unset and gets a temporary folder; on a
    cluster that folder would be another one on every machine, so it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")
    return base


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


class Kept:
    """Tables written to the shared checkpoint folder and read again. Unlike a
    checkpoint, whose size estimate is a product over the joins before it, such
    a table is known to the planner by its true size, so no join takes it for
    small by mistake. What ``drop`` has not deleted goes when the session ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def _file(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, stem: str) -> str:
        """A new folder for tables."""
        path = shared_path(self.spark, stem)
        self.paths.append(path)
        p, fs = self._file(path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        return path

    def keep(self, df: DataFrame, stem: str = "kept") -> DataFrame:
        path = f"{self.folder(stem)}/rows"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            p, fs = self._file(path)
            fs.delete(p, True)
        self.paths = []
