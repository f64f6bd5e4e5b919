"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where none is set, as in local tests, a temporary one is made."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Shelf:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Writes a table and returns it as read back. ``rows``: about how many; small tables take few tasks."""
        if rows is not None:
            df = df.coalesce(max(4, min(rows // 100_000, int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._shelf_path = path
        return kept

    def like(self, df: DataFrame, stored: DataFrame) -> DataFrame:
        """``df``, a projection of a stored table, is dropped like it."""
        df._shelf_path = stored._shelf_path
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing needs any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._shelf_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
