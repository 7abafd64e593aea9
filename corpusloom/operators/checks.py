"""Quality checks as DataFrames: each gives one row (check_id, name, gate, status, violations, detail).

status is pass, warn, fail or unverified. Violations are counted whole in ``detail`` and shown up to SHOWN. Scene checks
are C1 to C7, checks of the abstraction graph G1 to G8; ``gated`` decides what blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import overlap, scenes, units

SHOWN, WORST = 50, 20
NOVEL = 3
#: fixed values: words too common to count as taken from a source
STOP_WORDS = frozenset(
    "a an the and or but if of to in on at by for with from as that this it its is was are were be been he she they them his her their him i you we not no so then there here up out into over about".split()
)


def result(violations: DataFrame, check_id: str, name: str, gate: bool, fail: Column | None = None, warn: Column | None = None, detail: DataFrame | None = None, worst: list[str] | None = None) -> DataFrame:
    """One row from a table of violations (column ``v``) and a one-row table of figures that ``fail`` and ``warn`` may use.

    Without ``fail`` any violation fails. ``worst`` names columns by whose order the first WORST are shown.
    """
    # all are counted; what is shown is a bounded top, so that no task holds them all
    if worst is None:
        shown = violations.select("v").distinct().orderBy("v").limit(SHOWN).agg(F.array_sort(F.collect_list("v")).alias("violations"))
    else:
        top = violations.select(F.struct(*worst, "v").alias("x")).orderBy("x").limit(WORST)
        shown = top.agg(F.array_sort(F.collect_list("x")).alias("_x")).select(F.col("_x.v").alias("violations"))
    row = violations.agg(F.count(F.lit(1)).alias("n_violations")).crossJoin(F.broadcast(shown))
    if detail is not None:
        row = row.crossJoin(F.broadcast(detail))  # one row by one row
    bad = F.col("n_violations") > 0 if fail is None else fail
    status = F.when(bad, "fail")
    if warn is not None:
        status = status.when(warn, "warn")
    figures = ["n_violations", *(detail.columns if detail is not None else [])]
    kept = F.map_from_arrays(F.array(*(F.lit(c) for c in figures)), F.array(*(F.col(c).cast("double") for c in figures)))
    return row.select(F.lit(check_id).alias("check_id"), F.lit(name).alias("name"), F.lit(gate).alias("gate"), status.otherwise("pass").alias("status"), "violations", kept.alias("detail"))


def coverage(units: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected scene once, no other."""
    got = units.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    both = got.join(expected.select(F.col("scene_id").alias("e")).distinct(), F.col("scene_id") == F.col("e"), "full")
    state = F.when(F.col("e").isNull(), "unknown").when(F.col("scene_id").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return result(both.where(state.isNotNull()).select(F.concat_ws(" ", state, F.coalesce("scene_id", "e")).alias("v")), "C1", "coverage", True)


def source_runs(fields: DataFrame, source: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Runs that fields (path, text) share with source texts (scene_id, text), with the number of novel tokens of the longest."""
    runs = overlap.shared_runs(fields, source, "path", "scene_id")
    best = runs.groupBy("path").agg(F.max_by(F.struct("start", "run"), F.struct("run", -F.col("start"))).alias("b")).select("path", F.col("b.start").alias("start"), F.least(F.col("b.run"), F.lit(overlap.MOST)).alias("run"))
    known = F.array(*(F.lit(w) for w in sorted(STOP_WORDS | {t for e in exempt or [] for t in e.lower().split()})))
    tokens = fields.select("path", X.check_tokens(F.col("text")).alias("_t"))
    gram = F.slice("_t", F.col("start") + 1, F.col("run").cast("int"))
    return best.join(tokens, "path").select("path", "run", F.size(F.filter(gram, lambda t: ~F.array_contains(known, t))).alias("novel"), F.array_join(gram, " ").alias("gram"))


def verbatim(fields: DataFrame, source: DataFrame, exempt: list[str] | None = None, fail_at: int = overlap.FAIL, check_id: str = "C2", adjudicate: bool = True) -> DataFrame:
    """No field holds a run of ``fail_at`` tokens of the source; with adjudication only runs of NOVEL telling tokens count."""
    runs = source_runs(fields, source, exempt)
    counts = F.col("novel") >= NOVEL if adjudicate else F.lit(True)
    figures = runs.agg(F.coalesce(F.max("run"), F.lit(0)).alias("longest"), F.count_if(~counts).alias("dismissed"), F.count_if(counts).alias("adjudicated"))
    return result(runs.where(counts & (F.col("run") >= fail_at)).select(F.concat_ws(": ", "path", X.gram_digest(F.col("gram"))).alias("v")), check_id, "verbatim overlap", True, warn=F.col("adjudicated") > 0, detail=figures)


def scene_matches(fields: DataFrame, scenes: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """(scene_id, path, field, run, start, scope, gram, novel): the longest run that a field shares with its scene, or else its document.

    fields: doc, scene_id, field (unique), path, text; scenes: scene_id, text; documents: doc, text; known: scene_id and
    the tokens that must survive word for word, as an array. scope is scene or document. novel counts the gram's tokens
    that are neither known nor stop words. Fields of unknown scenes are left out.
    """
    place = lambda scope, c: F.struct(F.lit(scope).alias("scope"), F.col(c).cast("string").alias("place"))
    asked = fields.select("field", "scene_id", "path", F.array(place(0, "scene_id"), place(1, "doc")).alias("within"), "text")
    held = scenes.select(place(0, "scene_id").alias("x"), "text").unionByName(documents.select(place(1, "doc").alias("x"), "text")).select("x.*", "text")
    # what is known of scenes is asked for matches only, of which there are far fewer than fields
    own = overlap.longest_matches(asked, held, keep=("scene_id", "path")).join(scenes.select("scene_id"), "scene_id", "left_semi")
    met = own.join(known.select("scene_id", "tokens"), "scene_id", "left")
    dull = F.array_union(F.coalesce("tokens", F.array().cast("array<string>")), F.array(*(F.lit(w) for w in sorted(STOP_WORDS))))
    novel = X.bound(dull, lambda k: F.size(F.filter("gram", lambda t: ~F.array_contains(k, t))))
    return met.select("scene_id", "path", "field", "run", "start", F.when(F.col("scope") == 0, "scene").otherwise("document").alias("scope"), "gram", novel.alias("novel"))


def known_tokens(unit: DataFrame, scene: DataFrame) -> DataFrame:
    """(scene_id, tokens): check tokens of a scene's speakers, location and heading and of its unit's facts. scene: scene_id, speakers, location, heading."""
    facts = F.transform(units.WALK.found(unit.schema, "fact"), lambda x: x.value)
    of = scene.select("scene_id", F.concat(F.coalesce("speakers", F.array().cast("array<string>")), F.array("location", "heading")).alias("_s"))
    said = F.concat(F.col("_f"), F.coalesce("_s", F.array().cast("array<string>")))
    both = unit.select("scene_id", facts.alias("_f")).join(of, "scene_id", "left")
    return both.select("scene_id", F.array_distinct(F.flatten(F.transform(said, X.check_tokens))).alias("tokens"))


def scoped_verbatim(matches: DataFrame, known: DataFrame, fail_at: int = overlap.FAIL) -> DataFrame:
    """C2 over ``scene_matches``: a match counts as copied if NOVEL of its tokens are novel; shown are the longest, most novel first.

    The detail holds the longest match of all and the longest that counts, the fields that warn and fail, those dismissed
    as facts only, and how many tokens a unit's facts exempt on the average.
    """
    counts = F.col("novel") >= NOVEL
    figures = matches.agg(
        F.coalesce(F.max("run"), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(counts, F.col("run"))), F.lit(0)).alias("longest_adjudicated"), F.count_if(counts).alias("adjudicated"),
        F.count_if(counts & (F.col("run") >= fail_at)).alias("failing"), F.count_if(~counts).alias("dismissed"),
    ).crossJoin(F.broadcast(known.agg(F.coalesce(F.round(F.avg(F.size("tokens")), 1), F.lit(0.0)).alias("mean_exempt"))))
    shown = matches.where(counts).select((-F.col("run")).alias("_run"), (-F.col("novel")).alias("_novel"), "field", F.format_string("%s %s %d/%d %s %s", "scene_id", "path", "run", "novel", "scope", X.gram_digest(F.array_join("gram", " "))).alias("v"))
    return result(shown, "C2", "verbatim overlap", True, fail=F.col("failing") > 0, warn=F.col("adjudicated") > 0, detail=figures, worst=["_run", "_novel", "field"])


def match_lengths(matches: DataFrame) -> DataFrame:
    """(run, n): how many fields' counting matches have each length."""
    return matches.where(F.col("novel") >= NOVEL).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def numbers_kept(stated: DataFrame, source: DataFrame) -> DataFrame:
    """Stated (scene_id, number) must not differ from the scene's numbers in one character; numbers left out only warn."""
    drift = scenes.drifted(stated, source, "scene_id")
    lost = source.select("scene_id", "number").distinct().join(stated.select("scene_id", "number").distinct(), ["scene_id", "number"], "left_anti").agg(F.count(F.lit(1)).alias("omitted"))
    return result(drift.select(F.concat_ws(" ", "scene_id", "number", F.lit("for"), "original").alias("v")), "C3", "numbers", True, warn=F.col("omitted") > 0, detail=lost)


def beat_order(beats: DataFrame) -> DataFrame:
    """C4: orders 1..n once each, causes earlier than their beat. beats: scene_id, order, causes."""
    ranked = beats.withColumn("_r", F.row_number().over(Window.partitionBy("scene_id").orderBy("order")))
    gap = ranked.where(F.col("order") != F.col("_r")).select(F.format_string("%s#%d out of order", "scene_id", F.col("order").cast("long")).alias("v"))
    late = beats.select("scene_id", "order", F.explode("causes").alias("c")).where((F.col("c") >= F.col("order")) | (F.col("c") < 1)).select(F.format_string("%s#%d caused by %d", "scene_id", F.col("order").cast("long"), F.col("c").cast("long")).alias("v"))
    return result(gap.union(late), "C4", "beat order", True)


def references(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Ids in use (scene_id, path, entity_id) are declared by some unit (entity_id, auto); more than half of the records made by closure warn.

    Ids are compared once each, so that an id used everywhere meets its declaration in one row.
    """
    ids = used.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"))
    lost = ids.join(declared.select("entity_id").distinct(), "entity_id", "left_anti")
    dangling = used.join(lost.select("entity_id"), "entity_id", "left_semi").select(F.concat_ws(" ", "scene_id", "path", "entity_id").alias("v"))
    records = declared.agg(F.coalesce(F.avg(F.col("auto").cast("double")), F.lit(0.0)).alias("auto_share"), F.count_if("auto").alias("auto_declared"), F.count(F.lit(1)).alias("entity_records"), F.count_distinct("entity_id").alias("declared_ids"))
    return result(dangling, "C5", "references", False, warn=F.col("auto_share") > 0.5, detail=records.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("referenced_ids")))))  # one row by one row


def variety(values: DataFrame, most: float = 0.45, repeats: int = 2) -> DataFrame:
    """Values (field, ord, value) neither repeat more than ``repeats`` times nor resemble each other: median Jaccard above ``most``."""
    again = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > repeats).select(F.concat_ws(" ", "field", F.lit("repeats")).alias("v"))
    alike = scenes.band_median(values, "field", "ord", X.check_tokens(F.col("value")), step=None).where(F.col("median") > most).select(F.concat_ws(" ", "field", F.lit("alike")).alias("v"))
    return result(again.union(alike), "C6", "variety", False)


def canary(spark: SparkSession, emitted: int | None) -> DataFrame:
    """A window without a target yields nothing; None means that it wasn't run."""
    row = spark.range(1)
    status = "unverified" if emitted is None else "pass" if emitted == 0 else "fail"
    n = 0.0 if emitted is None else float(emitted)
    return row.select(F.lit("C7").alias("check_id"), F.lit("canary").alias("name"), F.lit(True).alias("gate"), F.lit(status).alias("status"), F.array().cast("array<string>").alias("violations"), F.create_map(F.lit("emitted"), F.lit(n)).alias("detail"))


# ---------------------------------------------------------------- abstraction graph
def grounding(objects: DataFrame, beats: DataFrame) -> DataFrame:
    """G1: each object cites beats, and each cited beat exists. objects: ao_id, grounded_in; beats: ref."""
    empty = objects.where(F.coalesce(F.size("grounded_in"), F.lit(0)) <= 0).select(F.concat(F.col("ao_id"), F.lit(" cites nothing")).alias("v"))
    cited = objects.select("ao_id", F.explode("grounded_in").alias("ref")).join(beats.select("ref"), "ref", "left_anti")
    return result(empty.union(cited.select(F.concat_ws(" cites ", "ao_id", "ref").alias("v"))), "G1", "grounding", True)


def restatement(objects: DataFrame, beats: DataFrame, least: float = 0.6, most: float = 0.15) -> DataFrame:
    """At most ``most`` of the objects say what a cited beat says: ``least`` of their tokens. beats: ref, content."""
    s = objects.select("ao_id", "statement", F.explode_outer("grounded_in").alias("ref")).join(beats, "ref", "left")
    share = s.groupBy("ao_id").agg(F.max(overlap.containment(X.check_tokens(F.col("statement")), X.check_tokens(F.col("content")))).alias("s"))
    flagged = share.where(F.col("s") >= least)
    figures = share.agg(F.coalesce(F.avg((F.col("s") >= least).cast("double")), F.lit(0.0)).alias("share"))
    return result(flagged.select(F.col("ao_id").alias("v")), "G2", "restatement", True, fail=F.col("share") > most, warn=F.col("n_violations") > 0, detail=figures)


def confidence(objects: DataFrame, most: float = 0.75) -> DataFrame:
    """No level of confidence holds more than ``most`` of the objects; near-certain theories of mind are listed."""
    g = objects.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(1.0)).alias("modal_share"))
    listed = objects.where("type = 'theory_of_mind' AND confidence = 'near-certain'").select(F.col("ao_id").alias("v"))
    return result(listed, "G3", "confidence", False, fail=F.col("modal_share") > most, detail=g)


def contradiction(evidence: DataFrame, least: float = 0.05) -> DataFrame:
    """Some evidence, and at least ``least`` of it against."""
    g = evidence.agg(F.count(F.lit(1)).alias("evidence"), F.coalesce(F.avg((F.col("stance") == "contradicts").cast("double")), F.lit(0.0)).alias("against"))
    return result(evidence.limit(0).select(F.lit("").alias("v")), "G4", "contradiction", False, fail=F.col("evidence") == 0, warn=F.col("against") < least, detail=g)


def linked(objects: DataFrame, links: DataFrame, least: float = 0.25) -> DataFrame:
    """At least ``least`` of the objects have a link; links to unknown objects are counted."""
    ids = objects.select("ao_id")
    ends = links.select(F.col("from_ao").alias("ao_id")).union(links.select("to_ao")).distinct()
    n = ids.join(ends.withColumn("_l", F.lit(1)), "ao_id", "left").agg(F.coalesce(F.avg(F.coalesce("_l", F.lit(0)).cast("double")), F.lit(0.0)).alias("linked_share"))
    dangling = links.join(ids, links["to_ao"] == ids["ao_id"], "left_anti").select(F.concat_ws(" ", "from_ao", "to_ao").alias("v"))
    return result(dangling, "G5", "links", False, fail=F.col("linked_share") < least, detail=n)


def spread(objects: DataFrame, scene_ids: DataFrame, least: float = 0.9) -> DataFrame:
    """At least ``least`` of the scenes have an object."""
    bare = scene_ids.select("scene_id").distinct().join(objects.select("scene_id").distinct(), "scene_id", "left_anti")
    all_ = scene_ids.select("scene_id").distinct().agg(F.count(F.lit(1)).alias("scenes"))
    return result(bare.select(F.col("scene_id").alias("v")), "G6", "scenes with objects", True, fail=F.col("n_violations") > (1 - least) * F.col("scenes") + 1e-9, detail=all_)


def minds(objects: DataFrame) -> DataFrame:
    """Warns where no object is a theory of mind."""
    n = objects.agg(F.count_if(F.col("type") == "theory_of_mind").alias("theories"))
    return result(objects.limit(0).select(F.lit("").alias("v")), "G7", "theory of mind", False, fail=F.lit(False), warn=F.col("theories") == 0, detail=n)


def graph_verbatim(objects: DataFrame, source: DataFrame) -> DataFrame:
    """Statement, reasoning and falsifier hold no long run of the source."""
    parts = [objects.select(F.concat_ws(".", "ao_id", F.lit(c)).alias("path"), F.col(c).alias("text")) for c in ("statement", "reasoning", "falsifier")]
    return verbatim(reduce(DataFrame.union, parts), source, check_id="G8", adjudicate=False)


def gated(checks: list[DataFrame], verified: list[str]) -> DataFrame:
    """All checks; a pass whose negative case wasn't run is unverified. ``blocking`` is a failed gate."""
    every = reduce(DataFrame.unionByName, checks)
    seen = F.col("check_id").isin(*verified) if verified else F.lit(False)
    status = F.when((F.col("status") == "pass") & ~seen, "unverified").otherwise(F.col("status"))
    return every.withColumn("status", status).withColumn("blocking", F.col("gate") & (F.col("status") == "fail"))


def gate_passed(checks: DataFrame) -> bool:
    return not checks.where("blocking").limit(1).count()
