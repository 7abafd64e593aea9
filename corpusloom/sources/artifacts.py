"""Stored results read back as tables: unit artifacts in their older forms too, instruments, judged answers; and reports from small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

_RELATION = "struct<predicate:string,target:string,attributes:string,target_id:string>"
_ENTITY = f"struct<name:string,entity_id:string,entity_type:string,type:string,aliases:array<string>,attributes:string,relationships:array<{_RELATION}>,relations:array<{_RELATION}>>"
_SOURCE = "struct<chunk_index:int,start_word:int,end_word:int,word_count:int,sha256:string,sentence_minhash:array<decimal(20,0)>>"
ARTIFACT = f"schema_version string, title string, abstract_sha256 string, mode string, model string, config string, knowledge_units array<struct<chunk_index:int,context_summary:string,entities:array<{_ENTITY}>,source:{_SOURCE},extraction_warnings:array<string>>>, canonical_entities array<struct<canonical_id:string,canonical_name:string,aliases:array<string>>>"
INSTRUMENT = "questions array<struct<question_id:string,scene_id:string,scene_index:int,question:string,options:array<string>,correct_index:int,fact_type:string>>"
JUDGED = "schema_version string, extractor_model string, judge_model string, rows array<struct<document_id:string,source_index:int,question_index:int,gold:string,predictions:map<string,string>>>, elapsed_seconds double"


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, schema_version, mode, model, chunk_index, context_summary, entities, source, warnings) of artifacts; what older ones lack gets defaults.

    ``relations`` stands for ``relationships`` and ``type`` for ``entity_type``; a missing predicate is ``related_to``.
    """
    rows = _whole(spark, path, ARTIFACT).select(F.col("_metadata.file_path").alias("path"), "schema_version", "mode", "model", F.explode("knowledge_units").alias("u"))

    def relation(r):
        return F.struct(F.coalesce(F.nullif(r.predicate, F.lit("")), F.lit("related_to")).alias("predicate"), X.text_of(r.target).alias("target"), r.attributes.alias("attributes"), r.target_id.alias("target_id"))

    def entity(e):
        return F.struct(
            X.text_of(e["name"]).alias("name"), X.text_of(e.entity_id).alias("entity_id"), F.coalesce(F.nullif(e.entity_type, F.lit("")), F.nullif(e.type, F.lit("")), F.lit("concept")).alias("entity_type"), F.coalesce(e.aliases, F.array().cast("array<string>")).alias("aliases"), e.attributes.alias("attributes"),
            F.transform(F.coalesce(e.relationships, e.relations, F.array().cast(f"array<{_RELATION}>")), relation).alias("relationships"),
        )

    none = F.array().cast("array<string>")
    return rows.select(
        "path", F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"), "mode", "model", F.coalesce("u.chunk_index", F.lit(0)).alias("chunk_index"), X.text_of(F.col("u.context_summary")).alias("context_summary"),
        F.transform(F.coalesce("u.entities", F.array().cast(f"array<{_ENTITY}>")), entity).alias("entities"), F.col("u.source").alias("source"), F.coalesce("u.extraction_warnings", none).alias("warnings"),
    )


def read_instrument(spark: SparkSession, path: str) -> DataFrame:
    """The questions of instrument files, one row each."""
    return _whole(spark, path, INSTRUMENT).select(F.explode("questions").alias("q")).select("q.*")


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, source_index, question_index, condition, gold, pred) of judged artifacts, one row a condition; a null prediction is an invalid one."""
    rows = _whole(spark, path, JUDGED).select(F.col("_metadata.file_path").alias("path"), F.explode("rows").alias("r"))
    return rows.select("path", "r.document_id", "r.source_index", "r.question_index", F.explode("r.predictions").alias("condition", "pred"), F.col("r.gold").alias("gold")).select("path", "document_id", "source_index", "question_index", "condition", "gold", "pred")


def with_cache(documents: DataFrame, cache: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents joined with their cached results; a document without one is an error that names how many lack it."""
    missing = documents.join(cache.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} documents have no cached result")
    return documents.join(cache, key)


def write_result(results: DataFrame, path: str) -> None:
    """One JSON object where there is one result, else a list, as a small file of the driver."""
    import json

    from .documents import write_json

    rows = [json.loads(x) for x in results.toJSON().collect()]
    write_json(path, rows[0] if len(rows) == 1 else rows)


def raw_then_gated(units: DataFrame, checks: DataFrame, path: str) -> bool:
    """Units as they are to <path>/raw before anything is judged, then the gated sink."""
    from .documents import write_gated

    units.write.mode("overwrite").parquet(f"{path}/raw")
    return write_gated(units, checks, path)


def worked_example(scene: DataFrame, beats: DataFrame, questions: DataFrame) -> str:
    """Markdown of one scene: its source, the beats of its unit, and its questions with the right option in bold. Each table is of one scene."""
    s = scene.first()
    lines = [f"## {s.scene_id}", "", *(f"> {line}" for line in (s.text or "").splitlines()), "", "| # | who | what |", "|-|-|-|"]
    lines += [f"| {b.order} | {b.actor or ''} | {b.content} |" for b in beats.orderBy("order").collect()]
    for q in questions.orderBy("question_id").collect():
        lines += ["", q.question, *(f"* {'**' if i == q.correct_index else ''}{o}{'**' if i == q.correct_index else ''}" for i, o in enumerate(q.options))]
    return "\n".join(lines) + "\n"
