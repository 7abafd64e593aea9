"""The two gated runs over stored tables: scenes' units against their source, and the abstraction graph against units and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, recall, scenes, units
from ..sources.artifacts import raw_then_gated
from ..sources.documents import write_gated


def scene_checks(unit: DataFrame, scene: DataFrame, canary_emitted: int | None = None, documents: DataFrame | None = None) -> list[DataFrame]:
    """C1 to C7. unit: units.UNIT; scene: scene_id, text, kind, location, speakers, stamps; doc_id and heading where it has them.

    Scenes of one ``doc_id`` are one document; without it all are, as a run of one text has it. ``documents`` (doc_id,
    text) has the whole texts; without them no run is found that goes from one scene into the next.
    """
    fields = units.text_fields(unit)
    paths = fields.select(F.concat_ws(".", "scene_id", "path").alias("path"), "scene_id", "text")
    # what a unit records, its heading included, as one text
    blobs = unit.select("scene_id", F.array_join(F.transform(units.WALK.found(unit.schema, "text", "heading"), lambda x: x.value), " ").alias("blob"))
    stated = paths.select("scene_id", F.explode(scenes.numbers(F.col("text"))).alias("number"))
    source = scene.select("scene_id", F.explode(scenes.numbers(F.col("text"))).alias("number"))
    beats = unit.select("scene_id", F.explode("beats").alias("b")).select("scene_id", F.col("b.order").alias("order"), F.coalesce("b.causes", F.array().cast("array<int>")).alias("causes"))
    shown = unit.select("scene_index", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("context_before", "context_after", "style")))).alias("f"))
    values = shown.select("f.field", F.col("scene_index").alias("ord"), "f.value").where(X.text_of(F.col("value")) != "")
    spark = unit.sparkSession
    of = scene.withColumn("doc", F.col("doc_id").cast("string") if "doc_id" in scene.columns else F.lit("all"))
    of = of.withColumn("heading", F.col("heading") if "heading" in scene.columns else F.lit(None).cast("string"))
    known = checks.known_tokens(unit, of)
    matches = checks.scene_matches(units.placed_fields(unit).join(of.select("scene_id", "doc"), "scene_id"), of, of if documents is None else documents.select(F.col("doc_id").cast("string").alias("doc"), "text"), known)
    return [
        checks.coverage(unit, scene),
        checks.scoped_verbatim(matches, known),
        recall.fidelity(recall.recalled(scene, blobs), scenes.drifted(stated, source, "scene_id")),
        checks.beat_order(beats),
        checks.references(units.used_ids(unit), units.declared_ids(unit)),
        checks.variety(values),
        checks.canary(spark, canary_emitted),
    ]


def graph_checks(objects: DataFrame, unit: DataFrame, links: DataFrame, evidence: DataFrame, source: DataFrame) -> list[DataFrame]:
    """G1 to G8 over the live objects. source: scene_id, text."""
    now, beats = units.live(objects), units.beat_refs(unit)
    return [
        checks.grounding(now, beats),
        checks.restatement(now, beats),
        checks.confidence(now),
        checks.contradiction(evidence),
        checks.linked(now, links),
        checks.spread(now, unit.select("scene_id")),
        checks.minds(now),
        checks.graph_verbatim(now, source),
    ]


def run(spark: SparkSession, kind: str, tables: str, out: str, verified: list[str], canary_emitted: int | None = None) -> bool:
    """Checks the Parquet tables of a folder and writes the gated result; whether it was published."""
    read = lambda name: spark.read.parquet(f"{tables}/{name}")
    if kind == "scenes":
        unit = read("units")
        return raw_then_gated(unit, checks.gated(scene_checks(unit, read("scenes"), canary_emitted), verified), out)
    objects = read("objects")
    return write_gated(objects, checks.gated(graph_checks(objects, read("units"), read("links"), read("evidence"), read("scenes")), verified), out)
