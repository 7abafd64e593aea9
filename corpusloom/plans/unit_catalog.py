"""Queries of the scene and graph layers, over units made of whole driver tables: a conversation is a scene, its turns are beats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.nested import built
from ..operators import canonical, checks, entities, graph, instrument, overlap, recall, scenes, tree, units
from ..operators.units import UNIT
from .catalog import ORACLES, PARAGRAPHS, QUERIES, RUNS, TOKENS, _paragraphs, query, table

__all__ = ["ORACLES", "QUERIES"]


def _scene():
    return F.concat(F.lit("sc-"), F.col("conv_id").cast("string"))


def _ref():
    return F.concat_ws("#", _scene(), (F.col("turn") + 1).cast("string"))


BEATS = "b AS (SELECT 'sc-' || conv_id AS scene_id, 'sc-' || conv_id || '#' || (turn + 1) AS ref, turn + 1 AS o, role, text FROM conversations)"
TYPES = ("motive", "theory_of_mind", "theme", "pattern")


def _beats(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(_scene().alias("scene_id"), _ref().alias("ref"), (F.col("turn") + 1).cast("int").alias("order"), F.col("role").alias("actor"), F.col("text").alias("content"))


def _pick(key: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# objects: one for each document; every fifth cites nothing, others a beat that may not exist
OBJECTS = (
    "o AS (SELECT 'ao-' || doc_id AS ao_id, doc_id, ['motive', 'theory_of_mind', 'theme', 'pattern'][doc_id % 4 + 1] AS type, ['probable', 'plausible', 'probable', 'near-certain', 'probable'][doc_id % 5 + 1] AS confidence,"
    " 'sc-' || (doc_id % 250) AS scene_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['sc-' || (doc_id % 250) || '#' || (doc_id % 3 + 1)] END AS cites, text FROM documents)"
)


def _objects(spark, sf_dir) -> DataFrame:
    scene = F.concat(F.lit("sc-"), (F.col("doc_id") % 250).cast("string"))
    cites = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("#", scene, (F.col("doc_id") % 3 + 1).cast("string"))))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ao-"), F.col("doc_id").cast("string")).alias("ao_id"), "doc_id", _pick("doc_id", *TYPES).alias("type"), _pick("doc_id", "probable", "plausible", "probable", "near-certain", "probable").alias("confidence"),
        scene.alias("scene_id"), cites.alias("grounded_in"), F.col("text").alias("statement"),
    )


def _shown(check: DataFrame) -> DataFrame:
    return check.select("check_id", "status", F.col("detail")["n_violations"].alias("n_violations"), F.array_join("violations", "|").alias("violations"))


def _verdict(check: str, violations: str, status: str) -> str:
    """SQL of ``_shown`` from a query for violations (v) and an expression of the status over their number n."""
    return f" SELECT '{check}' AS check_id, {status} AS status, CAST(n AS DOUBLE) AS n_violations, v AS violations FROM (SELECT (SELECT count(*) FROM ({violations})) AS n, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT v FROM ({violations}) ORDER BY v LIMIT 50)), '') AS v)"


ANY = "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END"


# ---------------------------------------------------------------- scene checks
DRIFT = r"""n AS (SELECT source AS g, lang, x FROM (SELECT source, lang, unnest(regexp_extract_all(text, '[0-9]+(?:[-/:.][0-9]+)*')) AS x FROM documents)),
 a AS (SELECT DISTINCT g, x FROM n WHERE lang = 'en'), b AS (SELECT DISTINCT g, x FROM n WHERE lang <> 'en'), m AS (SELECT g, x FROM a WHERE length(x) >= 2 EXCEPT SELECT g, x FROM b),
 d AS (SELECT m.g || ' ' || m.x || ' for ' || min(b.x) AS v FROM m JOIN b ON m.g = b.g AND length(m.x) = length(b.x) AND hamming(m.x, b.x) = 1 GROUP BY m.g, m.x)"""


@query("WITH " + DRIFT + _verdict("C3", "SELECT v FROM d", "CASE WHEN n > 0 THEN 'fail' WHEN (SELECT count(*) FROM (SELECT g, x FROM b EXCEPT SELECT g, x FROM a)) > 0 THEN 'warn' ELSE 'pass' END"))
def number_check(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.col("source").alias("scene_id"), "lang", F.explode(scenes.numbers(F.col("text"))).alias("number"))
    return _shown(checks.numbers_kept(n.where("lang = 'en'"), n.where("lang <> 'en'")))


@query(
    "WITH x AS (SELECT 'sc-' || conv_id AS s, CASE WHEN conv_id % 10 = 3 THEN turn + 2 ELSE turn + 1 END AS o, CASE WHEN conv_id % 7 = 2 THEN turn + 2 ELSE turn END AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"
    + _verdict("C4", "SELECT s || '#' || o || ' out of order' AS v FROM x WHERE o <> k UNION ALL SELECT s || '#' || o || ' caused by ' || c FROM x WHERE c >= 1 AND c >= o", ANY)
)
def beat_order_check(spark, sf_dir):
    b = table(spark, sf_dir, "conversations")
    order = F.when(F.col("conv_id") % 10 == 3, F.col("turn") + 2).otherwise(F.col("turn") + 1)
    cause = F.when(F.col("conv_id") % 7 == 2, F.col("turn") + 2).otherwise(F.col("turn"))
    return _shown(checks.beat_order(b.select(_scene().alias("scene_id"), order.alias("order"), F.filter(F.array(cause), lambda c: c >= 1).alias("causes"))))


@query(
    "WITH t AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS i, count(*) OVER (PARTITION BY role) AS k, list_distinct("
    + TOKENS.format("text")
    + ") AS t FROM conversations), j AS (SELECT a.role, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS s FROM t a JOIN t b ON a.role = b.role AND b.i - a.i BETWEEN 1 AND 11 WHERE a.i % greatest(1, a.k // 60) = 0)"
    + _verdict("C6", "SELECT role || ' repeats' AS v FROM conversations GROUP BY role, text HAVING count(*) > 2 UNION ALL SELECT role || ' alike' FROM j GROUP BY role HAVING list_sort(list(s))[len(list(s)) // 2 + 1] > 0.1", ANY)
)
def variety_check(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select(F.col("role").alias("field"), F.struct("conv_id", "turn").alias("ord"), F.col("text").alias("value"))
    return _shown(checks.variety(v, most=0.1))


# ---------------------------------------------------------------- graph checks
@query("WITH " + BEATS + ", " + OBJECTS + _verdict("G1", "SELECT ao_id || ' cites nothing' AS v FROM o WHERE len(cites) = 0 UNION ALL SELECT ao_id || ' cites ' || r FROM (SELECT ao_id, unnest(cites) AS r FROM o) WHERE r NOT IN (SELECT ref FROM b)", ANY))
def grounding_check(spark, sf_dir):
    return _shown(checks.grounding(_objects(spark, sf_dir), _beats(spark, sf_dir)))


SHARES = f", s AS (SELECT ao_id, max(CASE WHEN len(x) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(x) END) AS s FROM (SELECT ao_id, list_distinct({TOKENS.format('p.text')}) AS x, list_distinct({TOKENS.format('b.text')}) AS y FROM p LEFT JOIN b ON b.ref = p.cite) GROUP BY ao_id)"


@query("WITH " + BEATS + ", p AS (SELECT 'ao-' || scene_id || '-' || o AS ao_id, text, scene_id || '#' || (o - 1) AS cite FROM b)" + SHARES + _verdict("G2", "SELECT ao_id AS v FROM s WHERE s >= 0.4", "CASE WHEN n > 0.15 * (SELECT count(*) FROM s) THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END"))
def restatement_check(spark, sf_dir):
    b = _beats(spark, sf_dir)
    o = b.select(F.concat_ws("-", F.lit("ao"), "scene_id", F.col("order").cast("string")).alias("ao_id"), F.col("content").alias("statement"), F.array(F.concat_ws("#", "scene_id", (F.col("order") - 1).cast("string"))).alias("grounded_in"))
    return _shown(checks.restatement(o, b.select("ref", "content"), least=0.4))


@query("WITH " + OBJECTS + _verdict("G3", "SELECT ao_id AS v FROM o WHERE type = 'theory_of_mind' AND confidence = 'near-certain'", "CASE WHEN (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM o GROUP BY confidence)) > 0.75 THEN 'fail' ELSE 'pass' END"))
def confidence_check(spark, sf_dir):
    return _shown(checks.confidence(_objects(spark, sf_dir)))


@query("SELECT 'G4' AS check_id, CASE WHEN count(*) = 0 THEN 'fail' WHEN avg(CAST(toxic = 1 AS DOUBLE)) < 0.05 THEN 'warn' ELSE 'pass' END AS status, CAST(count(*) AS DOUBLE) AS evidence, avg(CAST(toxic = 1 AS DOUBLE)) AS against FROM labels")
def contradiction_check(spark, sf_dir):
    e = table(spark, sf_dir, "labels").select(F.concat(F.lit("ao-"), F.col("doc_id").cast("string")).alias("ao_id"), F.when(F.col("toxic") == 1, "contradicts").otherwise("supports").alias("stance"))
    return checks.contradiction(e).select("check_id", "status", F.col("detail")["evidence"].alias("evidence"), F.col("detail")["against"].alias("against"))


def _links(spark, sf_dir) -> DataFrame:
    name = lambda c: F.concat(F.lit("ao-"), c.cast("string"))
    return table(spark, sf_dir, "labels").select(name(F.col("doc_id")).alias("from_ao"), name(F.col("doc_id") * 2 + 1).alias("to_ao"), _pick("doc_id", "causes", "echoes", "opposes").alias("link"))


LINKS = "l AS (SELECT 'ao-' || doc_id AS f, 'ao-' || (doc_id * 2 + 1) AS t, ['causes', 'echoes', 'opposes'][doc_id % 3 + 1] AS link FROM labels)"


@query("WITH " + OBJECTS + ", " + LINKS + _verdict("G5", "SELECT f || ' ' || t AS v FROM l WHERE t NOT IN (SELECT ao_id FROM o)", "CASE WHEN (SELECT avg(CAST(ao_id IN (SELECT f FROM l UNION SELECT t FROM l) AS DOUBLE)) FROM o) < 0.25 THEN 'fail' ELSE 'pass' END"))
def link_check(spark, sf_dir):
    return _shown(checks.linked(_objects(spark, sf_dir), _links(spark, sf_dir)))


@query("WITH " + BEATS + ", " + OBJECTS + _verdict("G6", "SELECT DISTINCT scene_id AS v FROM b WHERE scene_id NOT IN (SELECT scene_id FROM o)", "CASE WHEN n > 0.1 * (SELECT count(DISTINCT scene_id) FROM b) + 1e-9 THEN 'fail' ELSE 'pass' END"))
def spread_check(spark, sf_dir):
    return _shown(checks.spread(_objects(spark, sf_dir), _beats(spark, sf_dir).select("scene_id")))


@query("WITH " + OBJECTS + " SELECT 'G7' AS check_id, CASE WHEN count(*) FILTER (type = 'theory_of_mind') = 0 THEN 'warn' ELSE 'pass' END AS status, CAST(count(*) FILTER (type = 'theory_of_mind') AS DOUBLE) AS theories FROM o")
def minds_check(spark, sf_dir):
    return checks.minds(_objects(spark, sf_dir)).select("check_id", "status", F.col("detail")["theories"].alias("theories"))


@query(RUNS + " SELECT 'G8' AS check_id, CASE WHEN count(*) FILTER (r >= 8) > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, CAST(coalesce(max(r), 0) AS DOUBLE) AS longest, CAST(count(*) FILTER (r >= 8) AS DOUBLE) AS n_violations FROM (SELECT item_id, least(max(run), 25) AS r FROM runs GROUP BY item_id)")
def graph_verbatim_check(spark, sf_dir):
    o = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("ao_id"), F.col("text").alias("statement"), F.lit("none given").alias("reasoning"), F.lit("a fact against it").alias("falsifier"))
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("scene_id"), "text")
    return checks.graph_verbatim(o, source).select("check_id", "status", F.col("detail")["longest"].alias("longest"), F.col("detail")["n_violations"].alias("n_violations"))


@query("WITH " + OBJECTS + " SELECT 'C7' AS check_id, CASE WHEN count(*) FILTER (len(cites) = 0 AND doc_id < 0) = 0 THEN 'unverified' ELSE 'fail' END AS status, count(*) FILTER (len(cites) = 0 AND doc_id < 0) > 0 AS blocking FROM o UNION ALL SELECT 'G7', CASE WHEN count(*) FILTER (type = 'theory_of_mind') = 0 THEN 'warn' ELSE 'pass' END, false FROM o UNION ALL SELECT 'G1', CASE WHEN count(*) FILTER (len(cites) = 0) > 0 THEN 'fail' ELSE 'unverified' END, count(*) FILTER (len(cites) = 0) > 0 FROM o")
def gate_protocol(spark, sf_dir):
    o = _objects(spark, sf_dir)
    emitted = o.where("size(grounded_in) = 0 AND doc_id < 0").count()
    cited = o.select(F.explode("grounded_in").alias("ref")).distinct()
    every = checks.gated([checks.canary(spark, emitted), checks.minds(o), checks.grounding(o, cited)], verified=["G7"])
    return every.select("check_id", "status", "blocking")


# ---------------------------------------------------------------- objects and links
@query(
    "WITH " + OBJECTS + ", " + LINKS + ", e AS (SELECT CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS stance FROM labels)"
    + "".join(f" {'UNION ALL' if i else ''} SELECT '{f}' AS figure, {c} AS value, count(*) AS n FROM {t} GROUP BY ROLLUP ({c})" for i, (f, c, t) in enumerate((("type", "type", "o"), ("confidence", "confidence", "o"), ("link", "link", "l"), ("stance", "stance", "e"))))
)
def graph_stats(spark, sf_dir):
    stance = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "contradicts").otherwise("supports").alias("stance"))
    return graph.protocol_stats(_objects(spark, sf_dir), _links(spark, sf_dir), stance)


@query("WITH " + LINKS + " SELECT ao_id, count(*) FILTER (side = 'out') AS outgoing, count(*) FILTER (side = 'in') AS incoming FROM (SELECT f AS ao_id, 'out' AS side FROM l UNION ALL SELECT t, 'in' FROM l) GROUP BY ao_id")
def link_degrees(spark, sf_dir):
    x = _links(spark, sf_dir)
    ends = x.select(F.col("from_ao").alias("ao_id"), F.lit(1).alias("out")).unionByName(x.select(F.col("to_ao").alias("ao_id"), F.lit(0).alias("out")))
    return ends.groupBy("ao_id").agg(F.count_if(F.col("out") == 1).alias("outgoing"), F.count_if(F.col("out") == 0).alias("incoming"))


@query("WITH " + OBJECTS + ", d AS (SELECT 'ao-' || doc_id AS drop, max_by('ao-' || (doc_id - doc_id % 3), doc_id) AS keep FROM labels WHERE doc_id % 3 > 0 GROUP BY doc_id) SELECT ao_id, keep AS superseded_by FROM o LEFT JOIN d ON drop = ao_id AND keep IN (SELECT ao_id FROM o)")
def superseded_objects(spark, sf_dir):
    name = lambda c: F.concat(F.lit("ao-"), c.cast("string"))
    d = table(spark, sf_dir, "labels").where("doc_id % 3 > 0").select(name(F.col("doc_id") - F.col("doc_id") % 3).alias("keep"), name(F.col("doc_id")).alias("drop"), F.col("doc_id").alias("ord"))
    return graph.superseded(_objects(spark, sf_dir), d).select("ao_id", "superseded_by")


@query("WITH " + OBJECTS + " SELECT type, count(*) AS n FROM o WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY type")
def live_objects(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").select("doc_id", F.lit("x").alias("superseded_by")).distinct()
    return units.live(_objects(spark, sf_dir).join(gone, "doc_id", "left")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH s AS (SELECT conv_id, turn, 'ao-' || (conv_id * 3 + turn) AS stage FROM conversations), k AS (SELECT conv_id, list(stage ORDER BY turn) AS l FROM s WHERE stage IN (SELECT 'ao-' || doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY conv_id HAVING count(*) >= 2) SELECT conv_id, array_to_string(l, ',') AS stages FROM k"
)
def arc_stages(spark, sf_dir):
    arcs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("ao-"), (F.col("conv_id") * 3 + F.col("turn")).cast("string")).alias("s")))).alias("_s"))
    kept = units.arc_stages(arcs.select("conv_id", F.col("_s.s").alias("stages")), _objects(spark, sf_dir).where("doc_id % 2 = 0"))
    return kept.select("conv_id", F.array_join("stages", ",").alias("stages"))


@query("SELECT doc_id, format('ao-w{:03d}-{:03d}', doc_id // 7, row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1) AS ao_id FROM documents")
def object_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 7").alias("window"), F.col("doc_id").alias("ord"))
    return units.numbered(d).select("doc_id", "ao_id")


@query(
    "WITH " + OBJECTS + ", " + BEATS + ", r AS (SELECT DISTINCT scene_id, ref FROM b), x AS (SELECT ao_id, doc_id // 50 AS w, scene_id, cites, type, confidence FROM o), bad AS (SELECT ao_id, w, 'no grounds' AS error FROM x WHERE len(cites) = 0 UNION ALL SELECT ao_id, w, 'unknown grounds' FROM x WHERE len(cites) > 0 AND cites[1] NOT IN (SELECT ref FROM r) UNION ALL SELECT ao_id, w, 'scene outside the window' FROM x WHERE scene_id NOT IN (SELECT scene_id FROM r) UNION ALL SELECT ao_id, w, 'unknown type' FROM x WHERE type = 'pattern') SELECT w AS \"window\", ao_id, error FROM bad"
)
def draft_errors(spark, sf_dir):
    o = _objects(spark, sf_dir).withColumn("window", F.expr("doc_id div 50"))
    b = _beats(spark, sf_dir)
    # every window may use every scene here
    return graph.draft_errors(o, b.select("scene_id"), b.select("ref"), TYPES[:3])


@query(
    "WITH " + OBJECTS + ", u AS (SELECT 'ao-' || doc_id AS ao_id, quality AS k, ['speculative', 'near-certain', 'unsure', 'plausible'][CAST((doc_id * 7 + quality) % 4 AS INT) + 1] AS c FROM labels), g AS (SELECT ao_id, c FROM u WHERE c <> 'unsure') SELECT ao_id, coalesce(g.c, o.confidence) AS confidence FROM o LEFT JOIN g USING (ao_id)"
)
def research_updates(spark, sf_dir):
    o = _objects(spark, sf_dir)
    new = F.element_at(F.array(*map(F.lit, ("speculative", "near-certain", "unsure", "plausible"))), ((F.col("doc_id") * 7 + F.col("quality")) % 4 + 1).cast("int"))
    u = table(spark, sf_dir, "labels").select(F.concat(F.lit("ao-"), F.col("doc_id").cast("string")).alias("ao_id"), F.lit(0).alias("ord"), new.alias("new_confidence"), F.lit("").alias("why"))
    changed, *_ = graph.researched(o, u.select("ao_id", F.lit("supports").alias("stance")).limit(0), _links(spark, sf_dir), u, 1)
    return changed.select("ao_id", "confidence")


@query("WITH RECURSIVE c(a, t) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION ALL SELECT a, t // 2 FROM c WHERE t > 0) SELECT 'p' || a AS alias, 'p' || min(t) AS canonical FROM c GROUP BY a")
def alias_chains(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey > 0")
    return entities.resolved(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("alias"), F.concat(F.lit("p"), F.expr("p_partkey div 2").cast("string")).alias("canonical")))


# ---------------------------------------------------------------- units
def _units(spark, sf_dir) -> DataFrame:
    """Conversations as whole units: roles are entities under names in two cases, the first role is declared, others and a narrator aren't."""
    kind = T._parse_datatype_string(UNIT)
    beat, entity = kind["beats"].dataType.elementType, kind["entities"].dataType.elementType
    turn, conv = F.col("turn"), F.col("conv_id")
    change = F.struct(F.when(conv % 10 == 7, "ghost").otherwise(F.col("role")).alias("entity"), F.lit("mood").alias("field"), F.when(turn > 0, "calm").alias("from"), F.lit("tense").alias("to"))
    facts = F.struct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("quantities"), F.array().alias("dates"), F.array(F.initcap("role")).alias("proper_nouns"), F.lit(None).alias("locations"))
    b = built(beat, order=turn + 1, type=F.lit("speech"), actor=F.col("role"), content=F.col("text"), facts=facts, state_changes=F.filter(F.array(F.when(turn % 2 == 0, change)), lambda x: x.isNotNull()), causes=F.filter(F.array(turn.cast("int")), lambda t: t > 0), certainty=F.lit("stated"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", b.alias("b")))).alias("_b")).withColumn("beats", F.transform("_b", lambda x: x.b))
    first = F.get("beats", F.lit(0)).getField("actor")
    knows = F.struct(F.lit("knows").alias("predicate"), F.lit("the narrator").alias("target"), F.when(conv % 3 != 0, "old_narrator").alias("target_id"))
    person = built(
        entity, name=F.when(conv % 3 == 0, F.upper(first)).otherwise(first), entity_id=first, type=F.when(conv % 2 == 0, "person").otherwise("object"), aliases=F.array(F.initcap(first)),
        attributes=F.create_map(F.lit("tone"), F.lit("flat"), F.lit("seat"), (conv % 7).cast("string")), relationships=F.array(knows),
    )
    unit = built(
        kind, scene_id=_scene(), scene_index=conv, heading=F.struct(F.when(conv % 4 != 0, F.concat(F.lit("INT. ROOM "), (conv % 5).cast("string"))).alias("raw"), F.lit(None).alias("location")), context_before=F.when(conv % 2 == 0, F.concat(F.lit("before it all is quiet in room "), conv.cast("string"))).otherwise(""),
        context_after=F.when(conv % 3 == 0, F.lit("nobody speaks of it afterwards")), style=F.concat(F.lit("style of "), conv.cast("string")), present=F.array(first), referenced=F.array(F.lit("narrator")), beats=F.col("beats"), entities=F.array(person),
    )
    return g.select(unit.alias("u")).select("u.*")


SPOKEN = "c AS (SELECT 'sc-' || conv_id AS s, conv_id, turn, role, text, 'beats[' || (turn + 1) || ']' AS b, CASE WHEN conv_id % 10 = 7 THEN 'ghost' ELSE role END AS g FROM conversations)"
FIRST = "f AS (SELECT conv_id, role AS id, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END AS name, CASE WHEN conv_id % 2 = 0 THEN 'person' ELSE 'object' END AS type FROM conversations WHERE turn = 0)"


TEXTS = (
    "SELECT s AS scene_id, b || '.content' AS path, text FROM c WHERE text <> '' UNION ALL SELECT s, b || '.state_changes.field', 'mood' FROM c WHERE turn % 2 = 0 UNION ALL SELECT s, b || '.state_changes.from', 'calm' FROM c WHERE turn % 2 = 0 AND turn > 0"
    " UNION ALL SELECT s, b || '.state_changes.to', 'tense' FROM c WHERE turn % 2 = 0 UNION ALL SELECT 'sc-' || conv_id, 'style', 'style of ' || conv_id FROM f UNION ALL SELECT 'sc-' || conv_id, 'context_before', 'before it all is quiet in room ' || conv_id FROM f WHERE conv_id % 2 = 0"
    " UNION ALL SELECT 'sc-' || conv_id, 'context_after', 'nobody speaks of it afterwards' FROM f WHERE conv_id % 3 = 0 UNION ALL SELECT 'sc-' || conv_id, 'entities[' || id || '].attributes', unnest(['flat', CAST(conv_id % 7 AS VARCHAR)]) FROM f UNION ALL SELECT 'sc-' || conv_id, 'entities[' || id || '].relationships.target', 'the narrator' FROM f"
)
USED = (
    "u AS (SELECT conv_id, s, b || '.actor' AS p, role AS i FROM c UNION ALL SELECT conv_id, s, b || '.state_changes.entity', g FROM c WHERE turn % 2 = 0 UNION ALL SELECT conv_id, 'sc-' || conv_id, 'present', id FROM f UNION ALL SELECT conv_id, 'sc-' || conv_id, 'referenced', 'narrator' FROM f"
    " UNION ALL SELECT conv_id, 'sc-' || conv_id, 'relationships.target_id', 'old_narrator' FROM f WHERE conv_id % 3 <> 0)"
)


@query("WITH " + FIRST + ", " + SPOKEN + " " + TEXTS)
def unit_fields(spark, sf_dir):
    return units.text_fields(_units(spark, sf_dir))


@query("WITH " + FIRST + ", " + SPOKEN + ", " + USED + _verdict("C5", "SELECT s || ' ' || p || ' ' || i AS v FROM u WHERE i NOT IN (SELECT id FROM f)", ANY))
def reference_check(spark, sf_dir):
    u = _units(spark, sf_dir)
    return _shown(checks.references(units.used_ids(u), units.declared_ids(u)))


@query(
    "WITH " + FIRST + ", " + SPOKEN + ", " + USED + ", m AS (SELECT f.conv_id, list_sort(list(DISTINCT i) FILTER (i <> id)) AS l FROM u JOIN f USING (conv_id) GROUP BY f.conv_id)"
    " SELECT 'sc-' || conv_id AS scene_id, CAST(len(l) AS INT) AS auto_declared, 1 + len(l) AS entities, 'auto-declared ' || len(l) || ' entity id(s) referenced but not defined: ' || array_to_string(l, ', ') AS warning, replace(l[-1], '_', ' ') AS last_name FROM m"
)
def reference_closure(spark, sf_dir):
    done = units.closed(_units(spark, sf_dir))
    return done.select("scene_id", "auto_declared", F.size("entities").cast("long").alias("entities"), F.array_join("extraction_warnings", "|").alias("warning"), F.element_at("entities", -1)["name"].alias("last_name"))


@query(
    "WITH " + FIRST + ", n AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(conv_id)) AS k FROM f GROUP BY id, name), t AS (SELECT id, type, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(conv_id)) AS k FROM f GROUP BY id, type), a AS (SELECT id, x FROM f, LATERAL (SELECT unnest([name, upper(id[1]) || lower(id[2:])]) AS x)) SELECT n.id AS entity_id, name, type, (SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM a WHERE a.id = n.id AND x <> name) AS aliases, (SELECT count(*) FROM f WHERE f.id = n.id) AS scenes FROM n JOIN t USING (id) WHERE n.k = 1 AND t.k = 1"
)
def entity_roll_up(spark, sf_dir):
    return units.roll_up(_units(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "WITH x AS (SELECT *, regexp_extract_all(text, '[0-9]+') AS q FROM conversations), l AS (SELECT conv_id, turn, (turn + 1) || '. [speech] ' || role || ': ' || coalesce(text, 'None') || CASE WHEN len(q) > 0 THEN '  [' || array_to_string(q, '; ') || ']' ELSE '' END"
    " || CASE WHEN turn % 2 = 0 THEN chr(10) || '     ~ ' || CASE WHEN conv_id % 10 = 7 THEN 'ghost' ELSE role END || '.mood: ' || CASE WHEN turn = 0 THEN 'None' ELSE 'calm' END || ' -> tense' ELSE '' END AS line, role FROM x)"
    " SELECT 'sc-' || conv_id AS scene_id, '## sc-' || conv_id || ' | ' || CASE WHEN conv_id % 4 <> 0 THEN 'INT. ROOM ' || (conv_id % 5) ELSE '(no heading)' END || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Before: before it all is quiet in room ' || conv_id ELSE '' END"
    " || chr(10) || 'Present: ' || first(role ORDER BY turn) || chr(10) || string_agg(line, chr(10) ORDER BY turn) || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'After: nobody speaks of it afterwards' ELSE '' END AS digest FROM l GROUP BY conv_id"
)
def rendered_units(spark, sf_dir):
    return units.rendered(_units(spark, sf_dir)).select("scene_id", "digest")


@query(
    "WITH x AS (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn) AS l, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), a AS (SELECT conv_id, n FROM x WHERE turn = 0) SELECT 'sc-' || c.conv_id AS scene_id, CASE WHEN turn = 0 THEN 1 ELSE turn + 2 END AS \"order\", text AS content FROM conversations c UNION ALL SELECT 'sc-' || conv_id, 2, 'a beat put in' FROM a UNION ALL SELECT 'sc-' || conv_id, n + 2, 'another at the end' FROM a"
)
def perception_patch(spark, sf_dir):
    u = _units(spark, sf_dir)
    add = lambda after, ord_, said: u.select("scene_id", F.lit(after).alias("after_order"), F.lit(ord_).alias("ord"), F.lit("action").alias("type"), F.lit("narrator").alias("actor"), F.lit(None).cast("string").alias("addressee"), F.lit(said).alias("content"))
    done = graph.perceived(u, add(1, 0, "a beat put in").unionByName(add(10_000, 1, "another at the end")))
    return done.select("scene_id", F.explode("beats").alias("b")).select("scene_id", F.col("b.order").cast("long").alias("order"), "b.content")


# ---------------------------------------------------------------- scenes of a text
SCENES = "sc AS (SELECT doc_id, i, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, CAST(total AS BIGINT) AS total FROM p WHERE n >= 40)"


def _scenes(spark, sf_dir) -> DataFrame:
    return _paragraphs(spark, sf_dir).where("n >= 40").select("doc_id", F.concat_ws("-", F.lit("sc"), F.col("i").cast("string")).alias("scene_id"), F.col("i").alias("scene_index"), F.col("start").alias("start_char"), (F.col("start") + F.col("n")).alias("end_char"), "total")


@query("WITH " + PARAGRAPHS + ", " + SCENES + ", r AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM sc) SELECT doc_id, CAST(sum(stop - start) AS BIGINT) AS covered, round(sum(stop - start) / max(total), 4) AS coverage, count(*) FILTER (reach < start) AS gaps FROM r GROUP BY doc_id")
def attribution_report(spark, sf_dir):
    return units.attribution(_scenes(spark, sf_dir), F.col("total"))


@query("WITH " + PARAGRAPHS + ", " + SCENES + " SELECT sc.doc_id, 'sc-' || (i - 1) AS scene_id, substr(text, start + 1, stop - start) AS text, sha256(substr(text, start + 1, stop - start)) AS sha256, lag('sc-' || (i - 1)) OVER w AS preceded_by, lead('sc-' || (i - 1)) OVER w AS followed_by FROM sc JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY sc.doc_id ORDER BY i)")
def scene_sources(spark, sf_dir):
    s = _scenes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")), "doc_id")
    return units.source_refs(s, F.col("source")).select("doc_id", "scene_id", "text", "sha256", "preceded_by", "followed_by")


WINDOWED = ", k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) // 5 AS w, start, stop, total FROM sc), g AS (SELECT doc_id, w, min(start) AS a, max(stop) AS b, max(total) AS total FROM k GROUP BY doc_id, w)"


@query("WITH " + PARAGRAPHS + ", " + SCENES + WINDOWED + " SELECT g.doc_id, CAST(w AS INT) AS \"window\", substr(text, a + 1, b - a) AS target, substr(text, greatest(0, a - 500) + 1, a - greatest(0, a - 500)) AS before, substr(text, b + 1, least(total - 1, b + 500) - b) AS after FROM g JOIN documents USING (doc_id)")
def window_texts(spark, sf_dir):
    w = units.windows_of(scenes.tiles(_scenes(spark, sf_dir), "doc_id", "scene_index", out="window"), F.col("total") - 1, F.lit(500))
    return units.window_texts(w.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")), "doc_id"), F.col("source")).select("doc_id", "window", "target", "before", "after")


@query("WITH " + PARAGRAPHS + ", " + SCENES + WINDOWED + ", c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM g) SELECT doc_id, CAST(w AS INT) AS donor, a AS start_char, greatest(0, a - 500) AS context_start, least(total - 1, b + 500) AS context_end FROM c WHERE n >= 2 AND r = n // 2")
def canary_windows(spark, sf_dir):
    w = units.windows_of(scenes.tiles(_scenes(spark, sf_dir), "doc_id", "scene_index", out="window"), F.col("total") - 1, F.lit(500))
    return units.canaries(w).select("doc_id", F.col("donor"), "start_char", "context_start", "context_end")


@query("WITH " + PARAGRAPHS + ", " + SCENES + WINDOWED + " SELECT doc_id, CAST(w AS INT) AS left_window, CAST(lead(w) OVER (PARTITION BY doc_id ORDER BY w) AS INT) AS right_window FROM g QUALIFY right_window IS NOT NULL")
def seam_pairs(spark, sf_dir):
    return units.seams(scenes.tiles(_scenes(spark, sf_dir), "doc_id", "scene_index", out="window").select("doc_id", "window").distinct())


@query("SELECT doc_id, string_agg('sc-' || (i - 1) || '  [' || n || ' w]', chr(10) ORDER BY i) AS listing FROM (SELECT doc_id, i, len(list_filter(string_split_regex(l, '\\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) GROUP BY doc_id")
def scene_listing(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("scene_index", "text"))
    s = s.select("doc_id", "scene_index", F.concat_ws("-", F.lit("sc"), F.col("scene_index").cast("string")).alias("scene_id"), F.size(X.words(F.col("text"))).alias("word_count"), F.lit("").alias("heading"))
    return units.listing(s).select("doc_id", F.regexp_replace("listing", r"\](  )(?=\n|$)", "]").alias("listing"))


# ---------------------------------------------------------------- recall
DRAFT = "d AS (SELECT doc_id, doc_id % 6 = 5 AS pre, 'HEADING 7' || chr(10) || text || chr(10) || (doc_id % 90 + 10) || 'OMITTED ' || chr(10) || (doc_id % 40 + 1) || 'CLOSE ON DOOR ' || (doc_id % 40 + 1) || chr(10) || '(CONTINUED)' || chr(10) || 'page of 3/3/98' AS t FROM documents)"
LINES = r"""li AS (SELECT doc_id, unnest(string_split(t, chr(10))[2:]) AS l FROM d WHERE NOT pre),
 kept AS (SELECT doc_id, CASE WHEN regexp_matches(l, '^\s*\d+[A-Z].*\d+\s*$') AND regexp_extract(l, '^\s*(\d+)([A-Z].*?)(\d+)\s*$', 1) = regexp_extract(l, '^\s*(\d+)([A-Z].*?)(\d+)\s*$', 3) THEN regexp_extract(l, '^\s*(\d+)([A-Z].*?)(\d+)\s*$', 2) ELSE l END AS l FROM li
  WHERE NOT regexp_matches(l, '(?i)^\s*(?:\d+\s*OMITTED\s*\d*|OMITTED\s*\d*|\(?\s*(?:CONTINUED|MORE)\s*\)?\s*\d*|[-\s]*Rev\.?\s.*|\d+[A-Z]?\.?)\s*$') AND NOT contains(l, '3/3/98')),
 num AS (SELECT doc_id, unnest(regexp_extract_all(l, '\b\d[\d]*(?:[-/:.]\d+)+\b')) AS x FROM kept UNION SELECT doc_id, unnest(regexp_extract_all(regexp_replace(l, '\b\d[\d]*(?:[-/:.]\d+)+\b', ' ', 'g'), '\b\d[\d,.:]*\b')) FROM kept)"""


def _draft(spark, sf_dir) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), lambda m, a: (F.col("doc_id") % m + a).cast("string")
    t = F.concat(F.lit("HEADING 7\n"), "text", F.lit("\n"), n(90, 10), F.lit("OMITTED \n"), n(40, 1), F.lit("CLOSE ON DOOR "), n(40, 1), F.lit("\n(CONTINUED)\npage of 3/3/98"))
    return d.select("doc_id", F.when(F.col("doc_id") % 6 == 5, "PRE").otherwise("INT").alias("kind"), t.alias("text"))


@query("WITH " + DRAFT + ", " + LINES + " SELECT DISTINCT doc_id, x AS number FROM num")
def requirable_numbers(spark, sf_dir):
    return _draft(spark, sf_dir).select("doc_id", F.explode(recall.requirable_numbers(F.col("text"), F.col("kind"), F.array(F.lit("3/3/98")))).alias("number"))


NAMED = "nm AS (SELECT s_suppkey, s_name, ['Ana', 'BIG COP', 'Bob Lee', 'CLICK.', 'Ana Maria Lee', 'R2D2', 'Voice', 'O''Neil'][s_suppkey % 8 + 1] AS cue FROM supplier)"


@query("WITH " + NAMED + r" SELECT s_suppkey, cue, regexp_matches(trim(cue), '^[A-Za-z][A-Za-z .''#-]*$') AND NOT regexp_matches(trim(cue), '[.-]$') AND len(string_split(trim(cue), ' ')) <= 2 AND lower(trim(cue)) NOT IN ('big cop', 'voice') AS requirable FROM nm")
def requirable_names(spark, sf_dir):
    cue = F.element_at(F.array(*map(F.lit, ("Ana", "BIG COP", "Bob Lee", "CLICK.", "Ana Maria Lee", "R2D2", "Voice", "O'Neil"))), (F.col("s_suppkey") % 8 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumn("cue", cue)
    return s.select("s_suppkey", "cue", recall.requirable_name(F.col("cue")).alias("requirable"))


@query(
    "WITH " + DRAFT + ", " + LINES + r""", q AS (SELECT DISTINCT doc_id, x FROM num), bl AS (SELECT doc_id, regexp_extract_all(replace(text, '-', ' '), '\b\d[\d,.:]*\b') AS n FROM documents),
 h AS (SELECT q.doc_id, list_contains(n, x) OR (len(list_filter(string_split_regex(x, '[-/:.]'), lambda p: p <> '')) > 1 AND len(list_filter(string_split_regex(x, '[-/:.]'), lambda p: p <> '' AND NOT list_contains(n, p))) = 0) AS hit FROM q JOIN bl USING (doc_id)),
 pl AS (SELECT doc_id, len(list_intersect(["""
    + "'door', 'open'], "
    + TOKENS.format("replace(text, '-', ' ')")
    + ")) > 0 AS hit FROM documents) SELECT 'number' AS kind, count(*) AS total, avg(CAST(hit AS DOUBLE)) AS recall FROM h UNION ALL SELECT 'location', count(*), avg(CAST(hit AS DOUBLE)) FROM pl"
)
def recall_rates(spark, sf_dir):
    source = _draft(spark, sf_dir).select(F.col("doc_id").alias("scene_id"), "text", "kind", F.lit("DOOR, OPEN").alias("location"), F.array().cast("array<string>").alias("speakers"), F.array(F.lit("3/3/98")).alias("stamps"))
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene_id"), F.replace("text", F.lit("-"), F.lit(" ")).alias("blob"))
    return recall.recall_rates(recall.recalled(source, blobs))


# ---------------------------------------------------------------- instrument
ANSWER = """a AS (SELECT item_id, '{"questions":[' || '{"question":" who ' || item_id || '? ","options":["x","y","z","' || CASE WHEN item_id % 4 = 1 THEN ' X ' ELSE 'w' END || '"],"correct_index":' || item_id % 5 || '},{"question":"what","options":["1","2","3","4"],"correct_index":2,"fact_type":"number"}]}' AS j FROM benchmark)"""


@query(
    "WITH q AS (SELECT 'it-' || item_id AS scene_id, item_id % 4 = 1 OR item_id % 5 = 4 AS bad, item_id FROM benchmark) SELECT scene_id, scene_id || '-q1' AS question_id, 'who ' || item_id || '?' AS question, 'x|y|z|w' AS options, CAST(item_id % 5 AS INT) AS correct_index, 'who_did_what' AS fact_type FROM q WHERE NOT bad UNION ALL SELECT scene_id, scene_id || '-q2', 'what', '1|2|3|4', 2, 'number' FROM q"
)
def instrument_questions(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    said = F.format_string('{"questions":[{"question":" who %d? ","options":["x","y","z","%s"],"correct_index":%d},{"question":"what","options":["1","2","3","4"],"correct_index":2,"fact_type":"number"}]}', "item_id", F.when(F.col("item_id") % 4 == 1, " X ").otherwise("w"), F.col("item_id") % 5)
    q = instrument.questions_of(b.select(F.concat(F.lit("it-"), F.col("item_id").cast("string")).alias("scene_id"), said.alias("answer")))
    return q.withColumn("options", F.array_join("options", "|"))


@query(RUNS + " SELECT CAST(item_id AS VARCHAR) AS question_id, CAST(least(max(run), 20) AS INT) AS run_words FROM runs GROUP BY item_id")
def question_leaks(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.lit("which one?").alias("question"), F.array("text", F.lit("b"), F.lit("c"), F.lit("d")).alias("options"))
    return instrument.leaking(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query(r"SELECT conv_id, turn, coalesce(nullif(regexp_extract(upper(trim(text)), ';\s*([ABCD])\s*;', 1), ''), CASE WHEN upper(trim(text)) IN ('A', 'B', 'C', 'D') THEN upper(trim(text)) END, nullif(regexp_extract(upper(trim(text)), '\b([ABCD])\b', 1), '')) AS choice FROM conversations")
def layered_choice(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.layered_choice(F.col("text")).alias("choice"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN ' ' || text WHEN turn % 2 = 0 THEN text ELSE '' END AS text FROM conversations")
def without_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("<CONTEXT>gone\nas well</CONTEXT> "), "text")).when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("<style_analysis>"), F.lit("gone</style_analysis>")))
    return c.select("conv_id", "turn", X.without_context(wrapped).alias("text"))


@query(
    "SELECT doc_id, CASE WHEN len(k) = 0 THEN 0.0 ELSE least(1.0, 2.0 * len(list_filter(k, lambda x: length(x) < 40 AND upper(x) = x AND lower(x) <> x)) / len(k)) END AS ratio FROM (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN 'ANA' || chr(10) || text ELSE text END, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS k FROM documents)"
)
def dialogue_share(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ANA\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.dialogue_ratio(t).alias("ratio"))


# ---------------------------------------------------------------- classes and groups
ENDS = ("approach", "Method", "construction", "framework", "operator", "state basis", "basis", "groups", "theory", "Yang Mills theories", "Hilbert space (working space)", "widget")
NAMES = f"x AS (SELECT p_partkey, p_brand, p_name || ' ' || {list(ENDS)!r}[p_partkey % 12 + 1] AS name, CASE WHEN p_partkey % 5 = 0 THEN 'person' ELSE 'object' END AS type FROM part)"
CLASS = """CASE WHEN n LIKE '%hilbert space%' AND n LIKE '%working space%' THEN 'whole_lattice_working_space' WHEN list_contains(w, 'yang') AND list_contains(w, 'mills') AND w[-1] IN ('theory', 'theories') THEN 'yang_mills_theory' WHEN w[-1] IN ('approach', 'method') THEN 'procedure' WHEN w[-1] IN ('construction', 'procedure', 'process') THEN 'process' WHEN w[-1] = 'framework' THEN 'framework'
 WHEN len(list_intersect(w, ['hamiltonian', 'operator', 'matrix'])) > 0 THEN 'formal_object' WHEN list_contains(w, 'basis') AND len(list_intersect(w, ['element', 'elements', 'state', 'states'])) > 0 THEN 'basis_member' WHEN w[-1] IN ('basis', 'bases') THEN 'basis' WHEN w[-1] IN ('group', 'groups') THEN 'group' WHEN w[-1] IN ('theory', 'theories') THEN 'theory' WHEN type = 'person' THEN 'person' ELSE 'unspecified' END"""
CLASSED = NAMES + f", y AS (SELECT *, {CLASS} AS class FROM (SELECT *, string_split(n, ' ') AS w FROM (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM x)))"


def _named(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_brand").alias("doc_id"), F.concat_ws(" ", "p_name", _pick("p_partkey", *ENDS)).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "person").otherwise("object").alias("type"), F.col("p_partkey").alias("pos"))


@query("WITH " + CLASSED + " SELECT p_partkey, name, class FROM y")
def semantic_classes(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", "name", canonical.semantic_class(F.col("name"), F.array("type")).alias("class"))


@query(
    "WITH " + CLASSED + ", t AS (SELECT p_brand, lower(name) AS f, bool_or(type = 'person') AS person FROM y GROUP BY ALL), z AS (SELECT p_brand, name, CASE WHEN class IN ('person', 'unspecified') THEN CASE WHEN person THEN 'person' ELSE 'unspecified' END ELSE class END AS class, min(p_partkey) AS p FROM y JOIN t USING (p_brand) WHERE lower(name) = f GROUP BY ALL) SELECT p_brand AS doc_id, string_agg(name, '|' ORDER BY p) AS aliases FROM z GROUP BY p_brand, class HAVING count(*) >= 2"
)
def guarded_groups(spark, sf_dir):
    m = _named(spark, sf_dir)
    groups = m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_l")).select("doc_id", F.lit(0).alias("ord"), F.lit("none of them").alias("canonical_name"), F.col("_l.name").alias("aliases"))
    return canonical.guarded(groups, m).select("doc_id", F.array_join("aliases", "|").alias("aliases"))


@query("WITH " + NAMES + ", g AS (SELECT p_brand, regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', '', 'g') AS k, min(p_partkey) AS p, min_by(name, p_partkey) AS canonical FROM x GROUP BY ALL) SELECT p_brand AS doc_id, canonical AS canonical_name, trim(regexp_replace(lower(canonical), '[^a-z0-9]+', '_', 'g'), '_') AS canonical_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p) AS INT) AS ord FROM g")
def fallback_groups(spark, sf_dir):
    return canonical.all_groups(_named(spark, sf_dir)).select("doc_id", "canonical_name", "canonical_id", "ord")


@query()
def spelling_pairs(spark, sf_dir):
    return entities.spelling_pairs(table(spark, sf_dir, "part"), "p_brand", "p_name", 0.8)


@query()
def alias_candidates(spark, sf_dir):
    return entities.alias_pairs(table(spark, sf_dir, "supplier").withColumn("doc_id", F.expr("s_suppkey % 5")), "doc_id", "s_name")


@query("WITH e AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS m FROM embeddings GROUP BY label) SELECT label, round(m, 6) AS mean FROM e")
def mean_or_zero(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.coalesce(F.avg(F.get("embedding", F.lit(0)).cast("double")), F.lit(0.0)).alias("mean"))
    return e.withColumn("mean", F.round("mean", 6))


@query(RUNS + " SELECT item_id, doc_id, '[' || substr(sha256(g), 1, 16) || ':' || n || ']' AS redaction FROM (SELECT r.item_id, r.doc_id, array_to_string(list_slice(t.t, r.start + 1, r.start + least(r.run, 25)), ' ') AS g, least(r.run, 25) AS n FROM (SELECT item_id, doc_id, max(run) AS run, min_by(start, (-run, start)) AS start FROM runs GROUP BY item_id, doc_id) r JOIN t USING (item_id))")
def redacted_runs(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    runs = overlap.shared_runs(b, d, "item_id", "doc_id").groupBy("item_id", "doc_id").agg(F.max_by(F.struct("start", "run"), F.struct("run", -F.col("start"))).alias("r"))
    tokens = b.select("item_id", X.check_tokens(F.col("text")).alias("_t"))
    gram = F.array_join(F.slice("_t", F.col("r.start") + 1, F.least(F.col("r.run"), F.lit(overlap.MOST)).cast("int")), " ")
    return runs.join(tokens, "item_id").select("item_id", "doc_id", X.gram_digest(gram).alias("redaction"))


# ---------------------------------------------------------------- copied runs, by scope
LINED = "p AS (SELECT doc_id, i, a[i] AS t, a[i + 1] AS after FROM (SELECT doc_id, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), "
SCOPED = (
    LINED
    + "u AS (SELECT doc_id, i, doc_id || '#' || i AS sid, t, CASE i % 3 WHEN 1 THEN 'So ' || array_to_string(string_split(t, ' ')[3:20], ' ') WHEN 2 THEN coalesce(array_to_string(string_split(after, ' ')[1:9], ' '), '') || ' then' ELSE 'nothing of note happened here on that day' END AS said,"
    + " CASE WHEN i % 5 = 0 THEN array_to_string(string_split(t, ' ')[3:18], ' ') ELSE '' END AS facts FROM p), "
    + "x AS (SELECT sid, doc_id, list_distinct("
    + TOKENS.format("facts")
    + ") AS k, "
    + TOKENS.format("said")
    + " AS s, "
    + TOKENS.format("t")
    + " AS h FROM u), y AS (SELECT doc_id, "
    + TOKENS.format("text")
    + """ AS h FROM documents), a AS (SELECT sid, doc_id, s, p, array_to_string(s[p + 1:p + 6], ' ') AS g FROM (SELECT sid, doc_id, s, unnest(range(len(s) - 5)) AS p FROM x WHERE len(s) >= 6)),
 b AS (SELECT 0 AS scope, sid AS place, q, array_to_string(h[q + 1:q + 6], ' ') AS g FROM (SELECT sid, h, unnest(range(len(h) - 5)) AS q FROM x WHERE len(h) >= 6) UNION ALL SELECT 1, CAST(doc_id AS VARCHAR), q, array_to_string(h[q + 1:q + 6], ' ') FROM (SELECT doc_id, h, unnest(range(len(h) - 5)) AS q FROM y WHERE len(h) >= 6)),
 w AS (SELECT sid, s, 0 AS scope, sid AS place, p, g FROM a UNION ALL SELECT sid, s, 1, CAST(doc_id AS VARCHAR), p, g FROM a),
 m AS (SELECT sid, s, scope, p, p - q AS d, p - row_number() OVER (PARTITION BY sid, scope, p - q ORDER BY p) AS k FROM w JOIN b USING (scope, place, g)),
 r AS (SELECT sid, s, scope, min(p) AS start, least(25, count(*) + 5) AS run FROM m GROUP BY sid, s, scope, d, k),
 e AS (SELECT sid, s, scope, start, run, row_number() OVER (PARTITION BY sid ORDER BY run DESC, start, scope) AS nth FROM r),
 z AS (SELECT e.sid, run, start, scope, e.s[start + 1:start + run] AS gram, x.k FROM e JOIN x USING (sid) WHERE nth = 1),
 v AS (SELECT sid, CAST(run AS BIGINT) AS run, CAST(start AS BIGINT) AS start, CASE scope WHEN 0 THEN 'scene' ELSE 'document' END AS scope, array_to_string(gram, ' ') AS gram, len(list_filter(gram, lambda t: NOT list_contains(k, t) AND NOT list_contains(STOPS, t))) AS novel FROM z)
"""
).replace("STOPS", "[" + ", ".join(f"'{w}'" for w in sorted(checks.STOP_WORDS)) + "]")


def _lined(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of documents as scenes; units that copy their own line, the next one, or nothing; and the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    split = docs.select("doc", F.split("text", "\n").alias("a"))
    p = split.select("doc", "a", F.posexplode("a").alias("i", "t")).select("doc", (F.col("i") + 1).alias("i"), "t", F.get("a", F.col("i") + 1).alias("after")).withColumn("scene_id", F.concat_ws("#", "doc", F.col("i").cast("string")))
    part = lambda c, a, n: F.array_join(F.slice(F.split(c, " "), a, n), " ")
    said = F.when(F.col("i") % 3 == 1, F.concat(F.lit("So "), part("t", 3, 18))).when(F.col("i") % 3 == 2, F.concat(F.coalesce(part("after", 1, 9), F.lit("")), F.lit(" then"))).otherwise("nothing of note happened here on that day")
    kind = T._parse_datatype_string(UNIT)
    beat = kind["beats"].dataType.elementType
    facts = F.struct(F.array().alias("quantities"), F.array().alias("dates"), F.array(F.when(F.col("i") % 5 == 0, part("t", 3, 16)).otherwise("")).alias("proper_nouns"), F.lit(None).alias("locations"))
    unit = p.select("doc", built(kind, scene_id=F.col("scene_id"), scene_index=F.col("i"), beats=F.array(built(beat, order=F.lit(1), content=said, facts=facts))).alias("u")).select("doc", "u.*")
    return unit, p.select("doc", "scene_id", F.col("t").alias("text"), F.lit(None).cast("array<string>").alias("speakers"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("heading")), docs


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    unit, scene, docs = _lined(spark, sf_dir)
    known = checks.known_tokens(unit, scene)
    return checks.scene_matches(units.placed_fields(unit, "doc"), scene, docs, known), known


@query("WITH " + SCOPED + "SELECT sid AS scene_id, 'beats[1].content' AS path, run, start, scope, gram, novel FROM v")
def scene_matches(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return found.select("scene_id", "path", F.col("run").cast("long").alias("run"), F.col("start").cast("long").alias("start"), "scope", F.array_join("gram", " ").alias("gram"), F.col("novel").cast("long").alias("novel"))


@query("WITH " + SCOPED + "SELECT run, count(*) AS n FROM v WHERE novel >= 3 GROUP BY run")
def match_lengths(spark, sf_dir):
    return checks.match_lengths(_matched(spark, sf_dir)[0]).select(F.col("run").cast("long").alias("run"), "n")


@query(
    "WITH "
    + SCOPED
    + ", g AS (SELECT max(run) AS longest, max(run) FILTER (novel >= 3) AS adjudicated, count(*) FILTER (novel >= 3) AS warned, count(*) FILTER (novel >= 3 AND run >= 8) AS failing, count(*) FILTER (novel < 3) AS dismissed FROM v),"
    + " t AS (SELECT sid || ' beats[1].content ' || run || '/' || novel || ' ' || scope || ' [' || sha256(gram)[1:16] || ':' || run || ']' AS v, run, novel, sid FROM v WHERE novel >= 3 ORDER BY run DESC, novel DESC, sid LIMIT 20)"
    + " SELECT 'C2' AS check_id, CASE WHEN failing > 0 THEN 'fail' WHEN warned > 0 THEN 'warn' ELSE 'pass' END AS status, CAST(longest AS DOUBLE) AS longest, CAST(adjudicated AS DOUBLE) AS longest_adjudicated, CAST(warned AS DOUBLE) AS warned, CAST(failing AS DOUBLE) AS failing, CAST(dismissed AS DOUBLE) AS dismissed,"
    + " (SELECT round(avg(len(k)), 1) FROM x) AS mean_exempt, (SELECT string_agg(v, '|' ORDER BY run DESC, novel DESC, sid) FROM t) AS worst FROM g"
)
def scoped_verbatim_check(spark, sf_dir):
    r = checks.scoped_verbatim(*_matched(spark, sf_dir))
    of = lambda c, to: F.col("detail")[c].alias(to)
    return r.select("check_id", "status", of("longest", "longest"), of("longest_adjudicated", "longest_adjudicated"), of("adjudicated", "warned"), of("failing", "failing"), of("dismissed", "dismissed"), of("mean_exempt", "mean_exempt"), F.array_join("violations", "|").alias("worst"))


# ---------------------------------------------------------------- loops over the graph
def _merge_sql(levels: int = 3) -> str:
    parts = [
        "w AS (SELECT source, win, row_number() OVER (PARTITION BY source ORDER BY win) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, doc_id % 7 AS win FROM documents))",
        "l0 AS (SELECT d.source, d.doc_id AS d, r, n FROM documents d JOIN w ON w.source = d.source AND w.win = d.doc_id % 7)",
    ]
    out = []
    for v in range(1, levels + 1):
        parts += [
            f"p{v} AS (SELECT source, pair, min(d) FILTER (side = 0) AS kl, max(d) FILTER (side = 0) AS xl, min(d) FILTER (side = 1) AS kr, max(d) FILTER (side = 1) AS xr FROM (SELECT *, r >> {v} AS pair, (r >> {v - 1}) % 2 AS side FROM l{v - 1} WHERE ((2 * (r >> {v}) + 1) << {v - 1}) < n) GROUP BY ALL)",
            f"q{v} AS (SELECT p{v}.*, least(kl, kr) AS lo, greatest(xl, xr) AS hi, {v} AS level, (SELECT 'w' || a.win || '..w' || b.win FROM w a, w b WHERE a.source = p{v}.source AND b.source = a.source AND a.r = p{v}.pair << {v} AND b.r = least(a.n - 1, ((p{v}.pair + 1) << {v}) - 1)) AS span FROM p{v})",
            f"l{v} AS (SELECT l.* FROM l{v - 1} l LEFT JOIN q{v} q ON q.source = l.source AND q.pair = l.r >> {v} WHERE q.pair IS NULL OR NOT (l.d = hi AND lo <> hi))",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM q{v}" for v in range(1, levels + 1))
    parts += [
        f"q AS ({every})",
        "dup AS (SELECT source, level, pair, lo, hi FROM q WHERE lo <> hi)",
        "sup AS (SELECT source, hi AS d, max_by(lo, level * 1000 + pair) AS kept FROM dup GROUP BY ALL)",
        "tk AS (SELECT source, lo AS d, string_agg('ao-' || hi, ',' ORDER BY level, pair) AS took FROM dup GROUP BY ALL)",
    ]
    out = [
        "SELECT 'link' AS kind, source, level, pair, 'ao-' || lo AS a, 'ao-' || xr AS b, 'merge-L' || level AS said FROM q WHERE lo IS NOT NULL AND xr IS NOT NULL",
        "SELECT 'duplicate', source, level, pair, 'ao-' || lo, 'ao-' || hi, NULL FROM dup",
        "SELECT 'arc', source, level, pair, 'ao-' || kl, 'ao-' || xr, span FROM q WHERE kl IS NOT NULL AND xr IS NOT NULL",
        "SELECT 'object', source, NULL, NULL, 'ao-' || d, 'ao-' || kept, took FROM sup FULL JOIN tk USING (source, d)",
        "SELECT 'level', NULL, level, NULL, CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (lo <> hi) AS VARCHAR), CAST(count(*) FILTER (kl IS NOT NULL AND xr IS NOT NULL) AS VARCHAR) FROM q GROUP BY level",
    ]
    return "WITH " + ", ".join(parts) + " SELECT kind, source, CAST(level AS INT) AS level, CAST(pair AS INT) AS pair, a, b, said FROM (" + " UNION ALL ".join(out) + ")"


def _joined(level: int, pairs: DataFrame, members: DataFrame) -> tree.Joined:
    """By rule: the least of a pair's objects takes in the greatest and echoes the right side's greatest; an arc goes from the left's least to it."""
    end = lambda s, f: f(F.when(F.col("side") == s, F.col("key")))
    e = members.groupBy("source", "pair").agg(end(0, F.min).alias("kl"), end(0, F.max).alias("xl"), end(1, F.min).alias("kr"), end(1, F.max).alias("xr"))
    ao = lambda c: F.concat(F.lit("ao-"), c.cast("string"))
    lo, hi = F.least("kl", "kr"), F.greatest("xl", "xr")
    row = lambda n, **c: e.select("source", "pair", F.lit(n).alias("ord"), *(v.alias(k) for k, v in c.items()))
    none = F.lit("ao-none")
    links = row(0, from_ao=ao(lo), to_ao=ao(F.col("xr")), link=F.lit("echoes"), why=F.lit("rule")).unionByName(row(1, from_ao=none, to_ao=ao(lo), link=F.lit("echoes"), why=F.lit("unknown")))
    dup = row(0, keep=ao(lo), drop=ao(hi)).unionByName(row(1, keep=none, drop=ao(lo)))
    arcs = row(0, name=F.lit("arc"), subject=F.lit("all"), stages=F.array(ao(F.col("kl")), none, ao(F.col("xr"))), summary=F.lit("s")).unionByName(row(1, name=F.lit("short"), subject=F.lit("all"), stages=F.array(none, ao(F.col("kl"))), summary=F.lit("s")))
    return tree.Joined(links, dup, arcs)


@query(_merge_sql())
def merge_levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    objects = d.select("source", (F.col("doc_id") % 7).cast("int").alias("window"), F.concat(F.lit("w"), (F.col("doc_id") % 7).cast("string")).alias("label"), F.concat(F.lit("ao-"), F.col("doc_id").cast("string")).alias("ao_id"), F.col("doc_id").alias("key"))
    m = tree.merge_tree(objects, _joined, 3, "source")
    of = lambda df, kind, a, b, said: df.select(F.lit(kind).alias("kind"), "source", "level", "pair", F.col(a).alias("a"), F.col(b).alias("b"), said.alias("said"))
    marked = m.objects.where(F.col("superseded_by").isNotNull() | (F.size("absorbed") > 0)).withColumn("level", F.lit(None).cast("int")).withColumn("pair", F.lit(None).cast("int"))
    took = F.when(F.size("absorbed") > 0, F.array_join("absorbed", ","))
    arcs = m.arcs.withColumn("a", F.get("stages", F.lit(0))).withColumn("b", F.get("stages", F.lit(1)))
    stats = m.levels.select(F.lit("level").alias("kind"), F.lit(None).cast("string").alias("source"), "level", F.lit(None).cast("int").alias("pair"), *(F.col(c).cast("string").alias(n) for c, n in (("merges", "a"), ("duplicates", "b"), ("arcs", "said"))))
    return of(m.links, "link", "from_ao", "to_ao", F.col("via")).unionByName(of(m.duplicates, "duplicate", "keep", "drop", F.lit(None).cast("string"))).unionByName(of(arcs, "arc", "a", "b", F.col("span"))).unionByName(of(marked, "object", "ao_id", "superseded_by", took)).unionByName(stats)


def _research_sql(rounds: int = 2) -> str:
    level = lambda c: f"list_position(['speculative', 'plausible', 'probable', 'near-certain'], {c})"
    parts = ["o0 AS (SELECT doc_id % 50 AS w, 'ao-' || doc_id AS ao, doc_id AS key, ['speculative', 'plausible', 'probable', 'near-certain', 'hunch'][doc_id % 5 + 1] AS conf, 'given' AS said FROM documents)"]
    rows = []
    for r in range(1, rounds + 1):
        o = f"o{r - 1}"
        parts += [
            f"h{r} AS (SELECT w, ao, 0 AS ord, conf AS f, 'plausible' AS t FROM {o} WHERE key % 3 = {r % 3} UNION ALL SELECT w, ao, 1, 'plausible', 'near-certain' FROM {o} WHERE key % 3 = {r % 3} AND key % 2 = 1)",
            f"o{r} AS (SELECT o.w, o.ao, key, coalesce(n.t, conf) AS conf, said FROM {o} o LEFT JOIN (SELECT w, ao, max_by(t, ord) AS t FROM h{r} GROUP BY ALL) n ON n.w = o.w AND n.ao = o.ao UNION ALL SELECT w, printf('ao-w%03d-r{r}-000', w), {r} * 1000000 + w, 'speculative', 'round {r} sees ' || count(*) FROM {o} GROUP BY w)",
        ]
        rows += [
            f"SELECT 'evidence' AS kind, w, ao AS a, 'sc-' || w || '#' || (key % 3 + 1) AS b, CASE WHEN (key + {r}) % 2 = 0 THEN 'supports' ELSE 'contradicts' END AS said, {r} AS round FROM {o}",
            f"SELECT 'link', w, min_by(ao, key), max_by(ao, key), 'echoes', {r} FROM {o} GROUP BY w HAVING min(key) <> max(key)",
            f"SELECT 'history', w, ao, f || ' to ' || t, CAST(CAST(sign({level('t')} - coalesce(nullif({level('f')}, 0), 2)) AS INT) AS VARCHAR), {r} FROM h{r}",
        ]
    rows.append(f"SELECT 'object', w, ao, conf, said, CAST(floor(key / 1000000) AS INT) FROM o{rounds} WHERE key >= 1000000 OR key % 3 <> 2")
    return "WITH " + ", ".join(parts) + " SELECT kind, CAST(w AS INT) AS w, a, b, said, CAST(round AS INT) AS round FROM (" + " UNION ALL ".join(rows) + ")"


def _found(r: int, now: DataFrame) -> tree.Found:
    """By rule: evidence for each object, some of it told by the wrong window; a link over each window; confidences set twice; an object that counts those there."""
    scene = F.concat(F.lit("sc-"), F.col("window").cast("string"))
    e = now.select("window", "ao_id", F.concat(scene, F.lit("#"), (F.col("key") % 3 + 1).cast("string")).alias("beat_ref"), F.when((F.col("key") + r) % 2 == 0, "supports").otherwise("contradicts").alias("stance"), F.lit("rule").alias("why"))
    strange = e.withColumn("window", (F.col("window") + 1) % 50)
    links = now.groupBy("window").agg(F.min_by("ao_id", "key").alias("from_ao"), F.max_by("ao_id", "key").alias("to_ao")).where("from_ao <> to_ao").withColumn("link", F.lit("echoes")).withColumn("why", F.lit("rule"))
    told = now.where(F.col("key") % 3 == r % 3)
    step = lambda n, to: told.select("window", F.lit(n).alias("ord"), "ao_id", to.alias("new_confidence"), F.lit("rule").alias("why"))
    updates = step(0, F.lit("plausible")).unionByName(step(1, F.when(F.col("key") % 2 == 1, "near-certain").otherwise("certain")))
    seen = now.groupBy("window").agg(F.count(F.lit(1)).alias("n")).select("window", (F.lit(1_000_000 * r) + F.col("window")).cast("bigint").alias("key"), F.format_string(f"round {r} sees %d", "n").alias("statement"), scene.alias("scene_id"), F.lit("speculative").alias("confidence"))
    new = seen.withColumn("ord", F.lit(0)).withColumn("grounded_in", F.array(F.concat("scene_id", F.lit("#1")))).unionByName(seen.withColumn("ord", F.lit(1)).withColumn("grounded_in", F.array(F.lit("nowhere"))))
    return tree.Found(e.unionByName(strange), links, updates, new)


@query(_research_sql())
def research_rounds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    window = (F.col("doc_id") % 50).cast("int")
    scene = F.concat(F.lit("sc-"), window.cast("string"))
    objects = d.select(window.alias("window"), F.concat(F.lit("ao-"), F.col("doc_id").cast("string")).alias("ao_id"), F.col("doc_id").alias("key"), scene.alias("scene_id"), F.array(F.concat(scene, F.lit("#1"))).alias("grounded_in"), _pick("doc_id", "speculative", "plausible", "probable", "near-certain", "hunch").alias("confidence"), F.lit("given").alias("statement"))
    scenes_ = objects.select("window", "scene_id").distinct()
    beats = scenes_.select("window", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat("scene_id", F.lit("#"), i.cast("string")))).alias("ref"))
    x = tree.research(objects, scenes_, beats, _found, 2)
    of = lambda df, kind, a, b, said, r: df.select(F.lit(kind).alias("kind"), F.col("window").alias("w"), F.col(a).alias("a"), b.alias("b"), said.alias("said"), r.cast("int").alias("round"))
    history = x.history.join(x.objects.select("ao_id", "window"), "ao_id")
    kept = x.objects.where((F.col("key") >= 1_000_000) | (F.col("key") % 3 != 2))
    return (
        of(x.evidence, "evidence", "ao_id", F.col("beat_ref"), F.col("stance"), F.col("round")).unionByName(of(x.links, "link", "from_ao", F.col("to_ao"), F.col("link"), F.col("round")))
        .unionByName(of(history, "history", "ao_id", F.concat_ws(" to ", "from", "to"), F.col("step").cast("string"), F.col("round")))
        .unionByName(of(kept, "object", "ao_id", F.col("confidence"), F.col("statement"), F.coalesce("provenance.round", F.lit(0))))
    )
