"""Cutting lineage by checkpoints in the shared folder, and stored steps that a restart takes up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder of ``spark.checkpoint.dir``; a local folder only for a local session that names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file:///tmp/checkpoints/corpusloom")
    return df.checkpoint()


class Folder:
    """The file system of a path, whichever Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def committed(self, batches: str) -> list[str]:
        return [n for n in self.names(batches) if self.exists(f"{batches}/{n}/run/_SUCCESS")]


def stored(spark: SparkSession, path: str | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of ``path``, made and written only if it isn't there whole; without a path ``make`` is cut instead."""
    if path is None:
        return cut(make())
    at, folder = f"{path}/{name}", Folder(spark, path)
    if not folder.exists(f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
