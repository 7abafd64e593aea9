"""Document readers by suffix, evaluation tables, and gated or atomic sinks."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation

TEXT = (".txt", ".md", ".rst")


def read_documents(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """(ord, text, title, abstract) of a text, JSON, JSON-lines, CSV or Parquet input; other suffixes and missing columns are errors."""
    suffix = os.path.splitext(path.rstrip("/*"))[1].lower()
    if suffix in TEXT:
        raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("title"))
        return normalized(raw, "text")
    if suffix == ".pdf":
        return normalized(_pdf(spark, path), "text")
    readers = {".json": lambda: spark.read.json(path, multiLine=True), ".jsonl": lambda: spark.read.json(path), ".csv": lambda: spark.read.csv(path, header=True, multiLine=True, escape='"'), ".parquet": lambda: spark.read.parquet(path)}
    if suffix not in readers:
        raise ValueError(f"unsupported input: {path}")
    return normalized(readers[suffix](), text_column)


def normalized(rows: DataFrame, text_column: str) -> DataFrame:
    if text_column not in rows.columns:
        raise ValueError(f"no column {text_column!r}")
    pick = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return numbered(rows, "ord").select("ord", pick(text_column).alias("text"), pick("title").alias("title"), pick("abstract").alias("abstract"))


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Rows of files with their place from 0, by file and place in the file, however the files are split over tasks.

    Rows are told by their split and their number within the task; a count for each split, of which there are few beside
    the rows, gives how many come before. A table that isn't read from files is numbered by its partitions.
    """
    at = rows.withColumn("_id", F.monotonically_increasing_id())
    try:
        at = at.withColumn("_f", F.col("_metadata.file_path")).withColumn("_o", F.col("_metadata.file_block_start"))
    except AnalysisException:
        at = at.withColumn("_f", F.lit("")).withColumn("_o", F.shiftright("_id", 33))
    splits = at.groupBy("_f", "_o").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("_start", before - F.col("_first")).select("_f", "_o", "_start")
    return at.join(starts, ["_f", "_o"]).withColumn(out, F.col("_id") + F.col("_start")).drop("_f", "_o", "_id", "_start")


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    @F.pandas_udf("struct<text:string,title:string>")
    def pages(content: pd.Series) -> pd.DataFrame:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs pypdf") from e
        import io

        rows = []
        for data in content:
            reader = PdfReader(io.BytesIO(data))
            rows.append(("\n\n".join(p.extract_text() or "" for p in reader.pages), (reader.metadata or {}).get("/Title") or ""))
        return pd.DataFrame(rows, columns=["text", "title"])

    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return files.select(pages("content").alias("p"), stem.alias("stem")).select("p.text", F.coalesce(F.nullif("p.title", F.lit("")), "stem").alias("title"))


def selected(documents: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice by order; an empty one is an error."""
    rows = documents.orderBy("ord").offset(offset)
    rows = rows if limit is None else rows.limit(limit)
    if not rows.limit(1).count():
        raise ValueError("no documents selected")
    return rows


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, source_index, text, questions, answers) of a list-shaped or an expanded table."""
    rows = spark.read.parquet(path)
    indexed = numbered(rows, "idx")
    if dict(rows.dtypes)["question"].startswith("array"):
        good = evaluation.valid_pairs(indexed)
        return good.select(evaluation.document_id(F.col("text"), F.col("idx")).alias("document_id"), F.col("idx").alias("source_index"), "text", "questions", "answers")
    return evaluation.grouped_questions(indexed)


def write_json(path: str, value: object) -> None:
    """A small JSON file of the driver, complete or not there."""
    folder = os.path.dirname(os.path.abspath(path))
    Path(folder).mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, ensure_ascii=False)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_gated(result: DataFrame, checks: DataFrame, path: str) -> bool:
    """Checks go to <path>/protocol always; the result to <path>/published if no gate blocks, else to <path>/quarantine."""
    checks.write.mode("overwrite").parquet(f"{path}/protocol")
    passed = not checks.where("blocking").limit(1).count()
    result.write.mode("overwrite").parquet(f"{path}/{'published' if passed else 'quarantine'}")
    return passed


def write_csv_report(rows: DataFrame, path: str, decimals: int | None = None) -> None:
    """One CSV file with a header; doubles with a fixed number of decimals if asked for."""
    shown = [F.format_number(c, decimals).alias(c) if t == "double" and decimals is not None else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True)
