"""Scene units: flattened text fields, reference closure, patches, roll-ups, rendering, scene maps and the merge tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.nested import Leaf, Walk, built

UNIT = (
    "scene_id string, scene_index int, heading struct<raw:string,location:string>, context_before string, context_after string, style string, present array<string>, referenced array<string>,"
    " beats array<struct<`order`:int,type:string,actor:string,addressee:string,content:string,facts:struct<quantities:array<string>,dates:array<string>,proper_nouns:array<string>,locations:array<string>>,"
    "state_changes:array<struct<entity:string,field:string,`from`:string,`to`:string>>,causes:array<int>,certainty:string>>,"
    " entities array<struct<name:string,entity_id:string,type:string,aliases:array<string>,attributes:map<string,string>,relationships:array<struct<predicate:string,target:string,target_id:string>>>>,"
    " extraction_warnings array<string>"
)
#: fixed values: enumerations of a beat, the facts kept word for word, and what marks an entity that closure declared
BEAT_TYPES = ("action", "speech", "revelation", "state_change", "movement", "perception")
CERTAINTIES = ("stated", "implied_by_action", "ambiguous")
FACTS = ("quantities", "dates", "proper_nouns", "locations")
DECLARED_BY, CLOSURE = "declared_by", "reference_closure"
#: what the leaves of a unit are: authored text, ids in use, ids declared, facts that must survive word for word
WALK = Walk(
    {c: Leaf("text") for c in ("context_before", "context_after", "style", "beats.content", "beats.state_changes.field", "beats.state_changes.from", "beats.state_changes.to", "entities.attributes", "entities.relationships.target")}
    | {c: Leaf("id") for c in ("present", "referenced", "beats.actor", "beats.addressee", "beats.state_changes.entity")}
    | {"entities.relationships.target_id": Leaf("id", "relationships.target_id"), "entities.entity_id": Leaf("declared"), "heading.raw": Leaf("heading"), "heading.location": Leaf("heading")}
    | {f"beats.facts.{c}": Leaf("fact") for c in FACTS},
    {"beats": "order", "entities": "entity_id"},
)


def leaves(units: DataFrame, *kinds: str) -> DataFrame:
    """(scene_id, path, kind, value): the leaves of these kinds that hold something, one row each."""
    return units.select("scene_id", F.explode(WALK.found(units.schema, *kinds)).alias("x")).select("scene_id", "x.*")


def placed_fields(units: DataFrame, *keep: str) -> DataFrame:
    """(scene_id, *keep, field, path, text): as ``text_fields``, with a key for each; two attributes have one path and two keys."""
    each = units.select("scene_id", *keep, F.posexplode(WALK.found(units.schema, "text")).alias("i", "x"))
    return each.select("scene_id", *keep, F.format_string("%s/%05d", "scene_id", "i").alias("field"), "x.path", F.col("x.value").alias("text"))


def text_fields(units: DataFrame) -> DataFrame:
    """(scene_id, path, text): every authored string that isn't empty with its place."""
    return leaves(units, "text").select("scene_id", "path", F.col("value").alias("text"))


def beat_refs(units: DataFrame) -> DataFrame:
    """(scene_id, scene_index, order, ref, content): beats with their addresses."""
    b = units.select("scene_id", "scene_index", F.explode("beats").alias("b"))
    return b.select("scene_id", "scene_index", F.col("b.order").alias("order"), F.concat_ws("#", "scene_id", F.col("b.order").cast("string")).alias("ref"), F.col("b.content").alias("content"))


def used_ids(units: DataFrame) -> DataFrame:
    """(scene_id, path, entity_id) wherever a unit names an entity by its id."""
    return leaves(units, "id").select("scene_id", "path", F.col("value").alias("entity_id"))


def declared_ids(units: DataFrame) -> DataFrame:
    """(scene_id, entity_id, auto): the units' entity records, and whether closure made them."""
    e = units.select("scene_id", F.explode("entities").alias("e"))
    return e.select("scene_id", F.nullif("e.entity_id", F.lit("")).alias("entity_id"), F.coalesce(F.try_element_at("e.attributes", F.lit(DECLARED_BY)) == CLOSURE, F.lit(False)).alias("auto"))


def closed(units: DataFrame) -> DataFrame:
    """Units whose used ids are all declared: each missing one becomes an empty entity named after its id, with a warning.

    ``auto_declared`` is their number. A unit without a gap is as it was.
    """
    used = F.transform(WALK.found(units.schema, "id"), lambda x: x.value)
    own = F.transform(WALK.found(units.schema, "declared"), lambda x: x.value)
    kind = units.schema["entities"].dataType
    empty = lambda i: built(kind.elementType, name=F.replace(i, F.lit("_"), F.lit(" ")), entity_id=i, type=F.lit("other"), attributes=F.create_map(F.lit(DECLARED_BY), F.lit(CLOSURE)))
    u = units.withColumn("_missing", F.array_sort(F.array_distinct(F.array_except(used, own))))
    said = F.format_string("auto-declared %d entity id(s) referenced but not defined: %s", F.size("_missing"), F.array_join("_missing", ", "))
    gap = F.size("_missing") > 0
    return u.withColumns(
        {
            "auto_declared": F.size("_missing"),
            "entities": F.when(gap, F.concat(F.coalesce("entities", F.array().cast(kind)), F.transform("_missing", empty))).otherwise(F.col("entities")),
            "extraction_warnings": F.when(gap, F.concat(F.coalesce("extraction_warnings", F.array().cast("array<string>")), F.array(said))).otherwise(F.col("extraction_warnings")),
        }
    ).drop("_missing")


def unit_errors(units: DataFrame, expected: DataFrame) -> DataFrame:
    """(scene_id, error): shapes that a window's output must not have."""
    short = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) < 20
    bad = [
        (short("context_before") | short("context_after") | short("style"), "context or style too short"),
        (F.coalesce(F.size("beats"), F.lit(0)) < 1, "no beats"),
        (F.transform("beats", lambda b: b["order"]) != F.sequence(F.lit(1), F.greatest(F.size("beats"), F.lit(1))), "orders not 1 to n"),
        (F.exists("beats", lambda b: ~b.type.isin(*BEAT_TYPES) | ~b.certainty.isin(*CERTAINTIES)), "unknown type or certainty"),
        (F.exists("beats", lambda b: F.length(F.trim(F.coalesce(b.content, F.lit("")))) < 10), "content too short"),
        (F.exists("beats", lambda b: F.exists(F.coalesce(b.causes, F.array().cast("array<int>")), lambda c: (c < 1) | (c >= b["order"]))), "cause not before"),
    ]
    found = units.select("scene_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in bad)))).alias("error"))
    counted = units.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).join(expected.select(F.col("scene_id").alias("e")), F.col("scene_id") == F.col("e"), "full")
    wrong = counted.where(F.col("e").isNull() | F.col("scene_id").isNull() | (F.col("n") > 1)).select(F.coalesce("scene_id", "e").alias("scene_id"), F.lit("not exactly once").alias("error"))
    return found.unionByName(wrong)


def seams(windows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, left_window, right_window) of neighbours by number within a document."""
    after = F.lead("window").over(Window.partitionBy(doc).orderBy("window"))
    return windows.select(doc, F.col("window").alias("left_window"), after.alias("right_window")).where("right_window IS NOT NULL")


def renamed(units: DataFrame, aliases: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Units with ids replaced as the merges (doc, alias, canonical) of their document say, wherever they stand.

    A document's merges come as one map with its units; nothing of other documents is looked at.
    """
    table = aliases.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("_m"))
    met = units.join(table, doc, "left")
    return WALK.rewritten(met, lambda i: F.coalesce(F.try_element_at("_m", i), i), "id", "declared").select(*units.columns)


def patched(units: DataFrame, fixes: DataFrame) -> DataFrame:
    """Units with content replaced where ``fixes`` (scene_id, order, content) has an existing beat; a later fix of one beat wins by ``ord``."""
    per = fixes.groupBy("scene_id", "order").agg(F.max_by("content", "ord").alias("c")).groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("order", "c"))).alias("_f"))
    return units.join(per, "scene_id", "left").withColumn("beats", F.transform("beats", lambda b: b.withField("content", F.coalesce(F.col("_f")[b["order"]], b.content)))).drop("_f")


def roll_up(units: DataFrame) -> DataFrame:
    """(entity_id, name, type, aliases, scenes): the commonest name and type, first seen of equals; ids without a name are left out."""
    e = units.select("scene_id", "scene_index", F.posexplode("entities").alias("i", "e")).select("scene_id", F.struct("scene_index", "i").alias("p"), "e.*").where(F.coalesce("name", F.lit("")) != "")

    def common(c: str) -> DataFrame:
        n = e.groupBy("entity_id", c).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
        w = Window.partitionBy("entity_id").orderBy(F.desc("n"), "p")
        return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("entity_id", c)

    names = e.groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("name"), F.flatten(F.collect_set("aliases"))))).alias("_a"))
    seen = units.select("scene_id", F.explode(F.array_union("present", "referenced")).alias("entity_id")).groupBy("entity_id").agg(F.countDistinct("scene_id").alias("scenes"))
    out = common("name").join(common("type"), "entity_id").join(names, "entity_id").join(seen, "entity_id", "left")
    return out.select("entity_id", "name", "type", F.filter("_a", lambda a: a != F.col("name")).alias("aliases"), F.coalesce("scenes", F.lit(0)).alias("scenes"))


def rendered(units: DataFrame, verbosity: str = "full") -> DataFrame:
    """(scene_id, scene_index, digest): a compact text of each unit.

    ``minimal`` leaves out what was before and after, ``full`` has both, any other word what was before. Of a beat's facts
    its quantities and dates follow it.
    """
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    some = lambda c: F.nullif(c, F.lit(""))
    none = F.array().cast("array<string>")

    def beat(b: Column) -> Column:
        facts = F.concat(*(F.coalesce(b.facts[c], none) for c in FACTS[:2]))
        tail = F.when(F.size(facts) > 0, F.concat(F.lit("  ["), F.array_join(facts, "; "), F.lit("]"))).otherwise("")
        to = F.coalesce(F.concat(F.lit(" -> "), some(b.addressee)), F.lit(""))
        line = F.concat(shown(b["order"]), F.lit(". ["), shown(b.type), F.lit("] "), F.coalesce(some(b.actor), F.lit("?")), to, F.lit(": "), shown(b.content), tail)
        changes = F.transform(b.state_changes, lambda c: F.concat(F.lit("     ~ "), shown(c.entity), F.lit("."), shown(c.field), F.lit(": "), shown(c["from"]), F.lit(" -> "), shown(c["to"])))
        return F.concat(F.array(line), F.coalesce(changes, none))

    head = F.concat(F.lit("## "), shown(F.col("scene_id")), F.lit(" | "), F.coalesce(some(F.col("heading.raw")), F.lit("(no heading)")))
    before = F.concat(F.lit("Before: "), some(F.col("context_before"))) if verbosity != "minimal" else F.lit(None).cast("string")
    here = F.when(F.size("present") > 0, F.concat(F.lit("Present: "), F.array_join("present", ", ")))
    after = F.concat(F.lit("After: "), some(F.col("context_after"))) if verbosity == "full" else F.lit(None).cast("string")
    lines = F.concat(F.array(head, before, here), F.coalesce(F.flatten(F.transform("beats", beat)), none), F.array(after))
    return units.select("scene_id", "scene_index", F.array_join(F.array_compact(lines), "\n").alias("digest"))


def rendered_chain(units: DataFrame, documents: DataFrame, doc: str = "doc_id", verbosity: str = "full") -> DataFrame:
    """(doc, chain, tokens): a document's units in order under its heading, and about how many tokens that is.

    documents: doc, title, draft, draft_date, credited_as. A document without units has its heading alone.
    """
    or_ = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    keyed = units.select(doc, "scene_id").join(rendered(units, verbosity), "scene_id")
    body = keyed.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_index", "scene_id", "digest"))), lambda x: x.digest), "\n\n").alias("_body"))
    head = F.concat_ws(
        "\n",
        F.format_string("KNOWLEDGE UNITS — %s (%s, %s)", or_("title", "untitled"), or_("draft", "draft unknown"), or_("draft_date", "date unknown")),
        F.concat(F.lit("Credited as: "), or_("credited_as", "unknown")),
        F.lit("Scenes in order. Each scene lists its beats in the order the audience receives them."),
        F.lit(""),
    )
    chain = documents.join(body, doc, "left").select(doc, F.concat(head, F.coalesce("_body", F.lit(""))).alias("chain"))
    return chain.withColumn("tokens", X.estimated_tokens(F.col("chain")))


# ---------------------------------------------------------------- scene maps
def map_errors(scenes: DataFrame, source: Column, length: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, scene_id, error): bounds, start and end anchors, overlaps. scenes: doc, scene_id, start_char, end_char, start_quote, end_quote and what ``source`` needs."""
    body = F.substring(source, F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    quote = lambda c: F.substring(X.collapsed(F.col(c)), 1, 25)
    w = Window.partitionBy(doc).orderBy("start_char", "end_char")
    s = scenes.withColumn("_before", F.lag("end_char").over(w))
    bad = [
        ((F.col("start_char") < 0) | (F.col("end_char") > length) | (F.col("start_char") >= F.col("end_char")), "out of bounds"),
        (~F.startswith(X.collapsed(body), quote("start_quote")), "start differs"),
        (~F.contains(X.collapsed(body), quote("end_quote")), "end differs"),
        (F.col("_before") > F.col("start_char"), "overlap"),
    ]
    return s.select(doc, "scene_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in bad)))).alias("error"))


def attribution(scenes: DataFrame, length: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, covered, coverage, gaps): characters that a document's scenes cover, their share of ``length``, and the number of gaps."""
    w = Window.partitionBy(doc).orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_char").over(w), F.lit(0))
    s = scenes.select(doc, length.alias("_n"), (F.col("end_char") - F.col("start_char")).alias("n"), (reach < F.col("start_char")).cast("int").alias("g"))
    return s.groupBy(doc).agg(F.sum("n").alias("covered"), F.round(F.try_divide(F.sum("n"), F.max("_n")), 4).alias("coverage"), F.sum("g").alias("gaps"))


def source_refs(scenes: DataFrame, source: Column, doc: str = "doc_id") -> DataFrame:
    """Scenes with their text cut from ``source``, its digest and fingerprint, and the scenes before and after them."""
    from .overlap import token_minhash
    from .scenes import chain

    cut = F.substring(source, (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    s = chain(scenes.withColumn("text", cut), doc, "scene_index", "scene_id")
    return s.withColumn("sha256", X.sha256(F.col("text"))).withColumn("sentence_minhash", token_minhash()("text"))


def windows_of(scenes: DataFrame, length: Column, context: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, window, scene_ids, start_char, end_char, context_start, context_end): numbered groups of scenes with ``context`` characters around them."""
    g = scenes.withColumn("_n", length).groupBy(doc, "window").agg(F.array_sort(F.collect_list(F.struct("scene_index", "scene_id"))).alias("_s"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.max("_n").alias("_n"))
    return g.select(doc, "window", F.col("_s.scene_id").alias("scene_ids"), "start_char", "end_char", F.greatest(F.lit(0), F.col("start_char") - context).alias("context_start"), F.least(F.col("_n"), F.col("end_char") + context).alias("context_end"))


def characters_a_word(length: Column, words: Column) -> Column:
    """What a page of words takes in characters of this text; 6.0 for a text whose scenes have no words."""
    return F.when(F.coalesce(words, F.lit(0)) > 0, length / words).otherwise(F.lit(6.0))


def window_texts(windows: DataFrame, source: Column) -> DataFrame:
    """Windows with ``target``, ``before`` and ``after``; a canary's target is empty, since it ends where it starts."""
    part = lambda a, b: F.substring(source, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    return windows.withColumn("target", part("start_char", "end_char")).withColumn("before", part("context_start", "start_char")).withColumn("after", part("end_char", "context_end"))


def canaries(windows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each document of two windows or more the middle one as a canary: its scenes and surroundings with nothing between, numbered -1."""
    w = Window.partitionBy(doc)
    placed = windows.withColumn("_r", F.row_number().over(w.orderBy("window")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    middle = placed.where((F.col("_n") >= 2) & (F.col("_r") == F.floor(F.col("_n") / 2)))
    return middle.withColumn("donor", F.col("window")).withColumn("window", F.lit(-1)).withColumn("end_char", F.col("start_char")).drop("_r", "_n")


def listing(scenes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, listing): a line for each scene with its id, words and heading, in order."""
    line = F.format_string("%s  [%d w]  %s", "scene_id", "word_count", F.coalesce("heading", F.lit("")))
    rows = scenes.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("scene_index", line.alias("line")))).alias("_l"))
    return rows.select(doc, F.array_join("_l.line", "\n").alias("listing"))


# ---------------------------------------------------------------- abstraction objects
def numbered(objects: DataFrame, window: str = "window", round_: int | None = None) -> DataFrame:
    """ao_id by window, research round and place."""
    k = F.row_number().over(Window.partitionBy(window).orderBy("ord")) - 1
    form = F.format_string("ao-w%03d-%03d", F.col(window), k) if round_ is None else F.format_string(f"ao-w%03d-r{round_}-%03d", F.col(window), k)
    return objects.withColumn("ao_id", form)


def merge_groups(groups: DataFrame) -> DataFrame:
    """The next level of the merge tree: groups in order by twos, an odd last one alone. groups: level, group."""
    k = F.row_number().over(Window.partitionBy("level").orderBy("group")) - 1
    return groups.withColumn("parent", F.floor(k / 2).cast("int")).select((F.col("level") + 1).alias("level"), "group", "parent")


def live(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("superseded_by").isNull())


def arc_stages(arcs: DataFrame, objects: DataFrame) -> DataFrame:
    """Arcs with stages that exist, two or more, in their order."""
    a = arcs.select("*", F.posexplode("stages").alias("_i", "ao_id")).drop("stages").join(objects.select("ao_id"), "ao_id", "left_semi")
    keys = [c for c in arcs.columns if c != "stages"]
    return a.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "ao_id"))).alias("_s")).where(F.size("_s") >= 2).select(*keys, F.col("_s.ao_id").alias("stages"))
