"""The abstraction graph as tables: drafts, research rounds, the merge tree, the editor's names, and repairs of what was perceived.

objects: ao_id, window, scene_id, type, confidence, grounded_in, ...; evidence: ao_id, beat_ref, stance, why; links: from_ao,
to_ao, link, why, via. Answers come as parsed tables; a row that names what its window lacks is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: confidence from least to most
CONFIDENCE = ("speculative", "plausible", "probable", "near-certain")


def level(confidence: Column) -> Column:
    """Place of a confidence among the four, from 0; null for another word."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence), F.lit(0)) - 1


def draft_errors(objects: DataFrame, scenes: DataFrame, beats: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(window, ao_id, error) of drafts with a missing or repeated id, a scene outside the window, no or unknown grounds, or an unknown type or confidence.

    scenes: window, scene_id; beats: window, ref; without ``window`` they stand in every window.
    """
    by = lambda df: ["window"] if "window" in df.columns else []
    known = scenes.select(*by(scenes), "scene_id", F.lit(True).alias("_scene")).distinct()
    times = F.count(F.lit(1)).over(Window.partitionBy("window", "ao_id"))
    given = objects.withColumn("_times", times).withColumn("_grounds", F.coalesce("grounded_in", F.array().cast("array<string>")))
    # lists of grounds that name what isn't there, each looked at once
    cited = given.select("window", "_grounds").distinct().withColumn("ref", F.explode("_grounds"))
    wrong = cited.join(beats.select(*by(beats), "ref").distinct(), [*by(beats), "ref"], "left_anti").select(F.col("window").alias("_w"), F.col("_grounds").alias("_g")).distinct()
    o = given.join(known, [*by(scenes), "scene_id"], "left").join(wrong, F.col("window").eqNullSafe(F.col("_w")) & (F.col("_grounds") == F.col("_g")), "left")
    grounds = F.col("_grounds")
    bad = [
        (F.coalesce("ao_id", F.lit("")) == "", "no id"),
        (F.col("_times") > 1, "repeated id"),
        (F.col("_scene").isNull(), "scene outside the window"),
        (F.size(grounds) == 0, "no grounds"),
        (F.col("_g").isNotNull(), "unknown grounds"),
        (~F.coalesce(F.col("type").isin(*types), F.lit(False)), "unknown type"),
        (level(F.col("confidence")).isNull(), "unknown confidence"),
    ]
    return o.select("window", "ao_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in bad)))).alias("error"))


def new_objects(found: DataFrame, scenes: DataFrame, beats: DataFrame, round_: int) -> DataFrame:
    """Research's new objects (window, ord, scene_id, grounded_in, ...) that stand on their window's own scenes and beats, with their ids."""
    refs = beats.groupBy("window").agg(F.collect_set("ref").alias("_refs"))
    o = found.join(scenes.select("window", "scene_id").distinct(), ["window", "scene_id"], "left_semi").join(refs, "window", "left")
    grounded = (F.coalesce(F.size("grounded_in"), F.lit(0)) > 0) & (F.size(F.array_except("grounded_in", F.coalesce("_refs", F.array().cast("array<string>")))) == 0)
    return o.where(grounded).drop("_refs").withColumn("ao_id", F.format_string(f"ao-w%03d-r{round_}-%03d", "window", "ord"))


def researched(objects: DataFrame, evidence: DataFrame, links: DataFrame, updates: DataFrame, round_: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(objects, evidence, links, history) after a round: rows of known objects only, and each object's last named confidence.

    updates: ao_id, ord, new_confidence, why. history has every step with its round, whether up, down or level.
    """
    ids = objects.select("ao_id")
    kept_evidence = evidence.join(ids, "ao_id", "left_semi")
    kept_links = links.join(ids.withColumnRenamed("ao_id", "from_ao"), "from_ao", "left_semi").join(ids.withColumnRenamed("ao_id", "to_ao"), "to_ao", "left_semi")
    good = updates.where(level(F.col("new_confidence")).isNotNull()).join(objects.select("ao_id", F.col("confidence").alias("_was")), "ao_id")
    before = F.coalesce(F.lag("new_confidence").over(Window.partitionBy("ao_id").orderBy("ord")), F.col("_was"))
    step = F.signum(level(F.col("new_confidence")) - F.coalesce(level(before), F.lit(1))).cast("int")
    history = good.select("ao_id", "ord", before.alias("from"), F.col("new_confidence").alias("to"), step.alias("step"), "why", F.lit(round_).alias("round"))
    last = good.groupBy("ao_id").agg(F.max_by("new_confidence", "ord").alias("_new"))
    changed = objects.join(last, "ao_id", "left").withColumn("confidence", F.coalesce("_new", "confidence")).drop("_new")
    return changed, kept_evidence, kept_links, history


def superseded(objects: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Objects with ``superseded_by`` where a duplicate (keep, drop, ord) of two different known objects says so; the last of several counts."""
    ids = objects.select("ao_id")
    good = duplicates.where("keep <> drop").join(ids.withColumnRenamed("ao_id", "keep"), "keep", "left_semi").join(ids.withColumnRenamed("ao_id", "drop"), "drop", "left_semi")
    last = good.groupBy(F.col("drop").alias("ao_id")).agg(F.max_by("keep", "ord").alias("_by"))
    old = F.col("superseded_by") if "superseded_by" in objects.columns else F.lit(None).cast("string")
    return objects.withColumn("superseded_by", old).join(last, "ao_id", "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by")


def protocol_stats(objects: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(figure, value, n): objects by type and by confidence, links by kind, evidence by stance, each with its total (value null)."""
    count = lambda df, figure, c: df.rollup(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(figure).alias("figure"), F.col(c).alias("value"), "n")
    return count(objects, "type", "type").unionByName(count(objects, "confidence", "confidence")).unionByName(count(links, "link", "link")).unionByName(count(evidence, "stance", "stance"))


def perceived(units: DataFrame, beats: DataFrame) -> DataFrame:
    """Units with beats put in: (scene_id, after_order, ord, type, actor, addressee, content), one after the other as ``ord`` says.

    Each goes in after the place that it names among the beats of that moment, at the end at most; orders are then 1 to n
    again. Added beats are ``stated`` and have no causes; causes of old beats are left as they are.
    """
    listed = beats.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("ord", "after_order", "type", "actor", "addressee", "content"))).alias("_new"))
    u = units.join(listed, "scene_id", "left")
    kind = units.schema["beats"].dataType.elementType

    def put(have, x):
        fields = {"order": F.lit(0), "causes": F.array().cast("array<int>"), "certainty": F.lit("stated"), "type": x.type, "actor": x.actor, "addressee": x.addressee, "content": x.content}
        beat = F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
        at = F.least(F.greatest(F.lit(0), F.coalesce(x.after_order, F.lit(0))), F.size(have))
        return F.concat(F.slice(have, F.lit(1), at), F.array(beat), F.slice(have, at + 1, F.size(have) - at))

    grown = F.aggregate("_new", F.coalesce("beats", F.array().cast(units.schema["beats"].dataType)), put)
    numbered = F.transform(grown, lambda b, i: b.withField("order", (i + 1).cast("int")))
    return u.withColumn("beats", F.when(F.col("_new").isNull(), F.col("beats")).otherwise(numbered)).drop("_new")


def state_changes(known: DataFrame, beats: DataFrame, missing: DataFrame, wrong: DataFrame) -> DataFrame:
    """(ref, entity, field, from, to, added, problem, correction): known changes, those added to beats that exist, and flags on wrong ones."""
    added = missing.join(beats.select("ref").distinct(), "ref", "left_semi").select("ref", "entity", "field", "from", "to", F.lit(True).alias("added"))
    every = known.select("ref", "entity", "field", "from", "to", F.lit(False).alias("added")).unionByName(added)
    flags = wrong.groupBy("ref", "entity", "field").agg(F.max_by(F.struct("problem", "correction"), "ord").alias("_w"))
    return every.join(flags, ["ref", "entity", "field"], "left").select("ref", "entity", "field", "from", "to", "added", F.col("_w.problem").alias("problem"), F.col("_w.correction").alias("correction"))


def usable(text: Column, least: int = 10) -> Column:
    """A repaired text that is long enough to stand for the old one."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


def restated(rows: DataFrame, repairs: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """Rows with ``value`` replaced where a usable repair (keys, restated) exists."""
    good = repairs.where(usable(F.col("restated"))).groupBy(*keys).agg(F.max(F.trim("restated")).alias("_r"))
    return rows.join(good, keys, "left").withColumn(value, F.coalesce("_r", value)).drop("_r")


def names_of(objects: DataFrame, units: DataFrame) -> DataFrame:
    """(name): distinct subjects, what objects are about, and entity ids."""
    said = objects.select(F.explode(F.array("subject", "about")).alias("name"))
    return said.union(units.select(F.explode("entities.entity_id").alias("name"))).where(F.coalesce("name", F.lit("")) != "").distinct()
