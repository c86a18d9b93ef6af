"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.stages import shared_folder


#: Spark's own setting to drop a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one run.  Writing cuts the lineage, so a lost executor costs one task, not the run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        with self.tidy():
            df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    @contextlib.contextmanager
    def tidy(self):
        """What is written inside leaves no shuffle files: the table is all that later steps read."""
        before = self.spark.conf.get(CLEAN_UP)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEAN_UP, before)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of frames that are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores added as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
