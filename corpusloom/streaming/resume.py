"""Resumable runs: results are appended in batches, finished documents are skipped, and a changed set-up is refused."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import Folder


def manifest_hash(config: dict) -> str:
    """Digest of a run's set-up; the batch size may change between runs."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "batch"}, sort_keys=True).encode()).hexdigest()


def remaining(documents: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return documents.join(done.select(key), key, "left_anti")


def resumable(documents: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, config: dict, key: str = "doc_id", batch: int = 10_000, most_batches: int | None = None) -> DataFrame:
    """Runs ``work`` over the documents not yet in ``path``, ``batch`` at a time, and returns all results; each once.

    The set-up's digest is written to ``path``/setup before anything else; another digest there is an error. A batch is a
    folder of ``path``/batches with its results, the documents dealt to it, and last a row on its run, whose success mark
    is the commit: after a stop at any point a batch counts whole or not at all, on any store, and what was left
    half-written is dropped at the next start. A document is finished when a committed batch was dealt it, whether
    or not ``work`` gave rows for it.
    """
    spark, digest = documents.sparkSession, manifest_hash(config)
    fs = Folder(spark, path)
    setup, batches = f"{path}/setup", f"{path}/batches"
    if fs.exists(f"{setup}/_SUCCESS"):
        if spark.read.parquet(setup).first()[0] != digest:
            raise ValueError("the results there belong to another set-up")
    else:
        spark.createDataFrame([(digest,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(setup)
    done = fs.committed(batches)
    for left in {*fs.names(batches)} - {*done}:
        fs.delete(f"{batches}/{left}")
    fs.delete(f"{path}/plans")
    if done:
        documents = remaining(documents, spark.read.parquet(*(f"{batches}/{d}/dealt" for d in done)), key)
    # 64 lanes of batch / 64 documents each: no window over all documents
    lane = max(1, batch // 64)
    order = documents.select(key).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)))
    plan = f"{path}/plans/{uuid.uuid4().hex}"
    # which batch a document falls to is settled once; a batch then reads its own part of the table
    order.withColumn("_batch", F.floor((F.col("_n") - 1) / lane).cast("int")).drop("_n").write.partitionBy("_batch").parquet(plan)
    dealt = spark.read.schema(T.StructType([documents.schema[key], T.StructField("_batch", T.IntegerType())])).parquet(plan)
    last = dealt.agg(F.max("_batch")).first()[0]
    for i in range(0 if last is None else min(last + 1, most_batches or last + 1)):
        start = time.time()
        mine = dealt.where(F.col("_batch") == i).select(key)
        name = f"b{len(done):06d}-{uuid.uuid4().hex}"
        draft = f"{batches}/{name}"
        work(documents.join(F.broadcast(mine) if batch <= 100_000 else mine, key, "left_semi")).write.parquet(f"{draft}/results")
        mine.write.parquet(f"{draft}/dealt")
        spark.createDataFrame([(digest, len(done), time.time() - start)], "manifest string, batch int, seconds double").coalesce(1).write.parquet(f"{draft}/run")
        done.append(name)
    fs.delete(f"{path}/plans")
    return results(spark, path)


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches; None before the first."""
    done = Folder(spark, path).committed(f"{path}/batches")
    return spark.read.parquet(*(f"{path}/batches/{d}/results" for d in done)) if done else None


def runs(spark: SparkSession, path: str) -> DataFrame | None:
    """(manifest, batch, seconds) of the committed batches; None before the first."""
    done = Folder(spark, path).committed(f"{path}/batches")
    return spark.read.parquet(*(f"{path}/batches/{d}/run" for d in done)) if done else None


def follow(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Processes the Parquet files of a folder that were not processed before, then stops: exactly once by the query's checkpoint."""

    def batch(df: DataFrame, epoch: int) -> None:
        work(df).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/batch_{epoch}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
