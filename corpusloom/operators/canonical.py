"""Entity resolution within documents: a model's alias groups, parted by semantic class, then names that are equal once folded.

Groups come as (doc_id, ord, canonical_name, aliases). Whatever a document's names give is one row a name or group, joined
by document and folded name; nothing crosses documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .entities import canonical_id


@dataclass(frozen=True)
class Rule:
    """A class and what a name of it shows: all ``phrases``, all or any of words, and one of the last words."""

    name: str
    phrases: tuple[str, ...] = ()
    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    last: tuple[str, ...] = ()


#: fixed values: classes whose names must not be merged with those of another, the first that fits
CLASSES = (
    Rule("whole_lattice_working_space", phrases=("hilbert space", "working space")),
    Rule("yang_mills_theory", every=("yang", "mills"), last=("theory", "theories")),
    Rule("procedure", last=("approach", "method")),
    Rule("process", last=("construction", "procedure", "process")),
    Rule("framework", last=("framework",)),
    Rule("formal_object", some=("hamiltonian", "operator", "matrix")),
    Rule("basis_member", every=("basis",), some=("element", "elements", "state", "states")),
    Rule("basis", last=("basis", "bases")),
    Rule("group", last=("group", "groups")),
    Rule("theory", last=("theory", "theories")),
)


def semantic_class(name: Column, types: Column) -> Column:
    """The class of a name by its words, else ``person`` where any of its observed ``types`` is one, else ``unspecified``."""
    plain = F.trim(F.regexp_replace(X.folded(name), "[^a-z0-9]+", " "))

    def of(p):
        words = F.split(p, " ")
        has = lambda w: F.array_contains(words, w)
        found = None
        for r in CLASSES:
            tests = [F.contains(p, F.lit(x)) for x in r.phrases] + [has(w) for w in r.every]
            if r.some:
                tests.append(F.arrays_overlap(words, F.array(*map(F.lit, r.some))))
            if r.last:
                tests.append(F.element_at(words, -1).isin(*r.last))
            test = tests[0]
            for t in tests[1:]:
                test = test & t
            found = F.when(test, r.name) if found is None else found.when(test, r.name)
        return found.when(F.coalesce(F.array_contains(types, "person"), F.lit(False)), "person").otherwise("unspecified")

    return X.bound(plain, of)


def guarded(groups: DataFrame, mentions: DataFrame, doc: str = "doc_id", name: str = "name", kind: str = "type") -> DataFrame:
    """(doc, ord, part, canonical_name, aliases): each group parted by class, parts of two names or more.

    A part keeps the group's name if it holds it, else takes its longest, the first of equals. part numbers a group's
    parts by the place of their first name.
    """
    observed = mentions.groupBy(doc, X.folded(F.col(name)).alias("_f")).agg(F.collect_set(kind).alias("_types"))
    a = groups.select(doc, "ord", "canonical_name", F.posexplode("aliases").alias("_i", "_a")).withColumn("_f", X.folded(F.col("_a")))
    first = a.join(observed, [doc, "_f"], "left").withColumn("_class", semantic_class(F.col("_a"), F.col("_types")))
    once = first.groupBy(doc, "ord", "canonical_name", "_class", "_a").agg(F.min("_i").alias("_i"))
    parts = once.groupBy(doc, "ord", "canonical_name", "_class").agg(F.array_sort(F.collect_list(F.struct("_i", "_a"))).alias("_l")).where(F.size("_l") >= 2)
    names = F.col("_l._a")
    longest = F.aggregate(names, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    part = F.row_number().over(Window.partitionBy(doc, "ord").orderBy(F.get("_l._i", F.lit(0)))) - 1
    return parts.select(doc, "ord", part.alias("part"), F.when(F.array_contains(names, F.col("canonical_name")), F.col("canonical_name")).otherwise(longest).alias("canonical_name"), names.alias("aliases"))


def fallback(mentions: DataFrame, mapped: DataFrame, doc: str = "doc_id", name: str = "name", place: str = "pos") -> DataFrame:
    """(doc, place, canonical_name, aliases): names that no group holds, grouped where they are equal but for case and punctuation.

    mapped: doc and _f, the folded names that groups hold.
    """
    seen = mentions.groupBy(doc, name).agg(F.min(place).alias("_p")).withColumn("_f", X.folded(F.col(name)))
    left = seen.join(mapped.select(doc, "_f").distinct(), [doc, "_f"], "left_anti").withColumn("_key", X.bare_key(F.col(name)))
    grouped = left.groupBy(doc, "_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("p"), F.col(name).alias("n")))).alias("_g"))
    return grouped.select(doc, F.get("_g.p", F.lit(0)).alias("place"), F.get("_g.n", F.lit(0)).alias("canonical_name"), F.col("_g.n").alias("aliases"))


def all_groups(mentions: DataFrame, groups: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, canonical_id, canonical_name, aliases): guarded groups first, fallback groups by first sight after them."""
    if groups is None:
        groups = mentions.select(doc, F.lit(0).alias("ord"), F.lit("").alias("canonical_name"), F.array().cast("array<string>").alias("aliases")).limit(0)
    kept = guarded(groups, mentions, doc)
    mapped = kept.select(doc, F.explode("aliases").alias("_a")).select(doc, X.folded(F.col("_a")).alias("_f"))
    rest = fallback(mentions, mapped, doc)
    order = lambda *c: F.row_number().over(Window.partitionBy(doc).orderBy(*c))
    both = kept.select(doc, F.lit(0).alias("_late"), F.struct(F.col("ord").cast("long").alias("a"), F.col("part").cast("long").alias("b")).alias("_o"), "canonical_name", "aliases").unionByName(
        rest.select(doc, F.lit(1).alias("_late"), F.struct(F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("_o"), "canonical_name", "aliases")
    )
    numbered = both.withColumn("ord", order("_late", "_o"))
    return numbered.select(doc, "ord", canonical_id("canonical_name").alias("canonical_id"), "canonical_name", "aliases")


def lookup(groups: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, alias, canonical_name, canonical_id, group_aliases, ord): every name of a group and its canonical one."""
    names = F.array_union("aliases", F.array("canonical_name"))
    return groups.select(doc, F.explode(names).alias("alias"), "canonical_name", "canonical_id", F.col("aliases").alias("group_aliases"), "ord")


def canonicalized(mentions: DataFrame, groups: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mentions (doc, pos, name, type, ...) with canonical name, id, aliases and the commonest type of their id; originals as ``original``."""
    last = lookup(groups, doc).withColumn("_f", X.folded(F.col("alias"))).groupBy(doc, "_f").agg(F.max_by(F.struct("canonical_name", "canonical_id", "group_aliases"), "ord").alias("_c"))
    m = mentions.withColumn("_f", X.folded(F.col("name"))).join(last, [doc, "_f"], "left")
    m = m.withColumn("_id", F.coalesce("_c.canonical_id", canonical_id("name")))
    kinds = m.groupBy(doc, "_id", "type").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_p")).groupBy(doc, "_id").agg(F.max_by("type", F.struct("_n", -F.col("_p"))).alias("_type"))
    aliases = F.when(F.col("_c").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat("_c.group_aliases", F.array("name")))))
    kept = [c for c in mentions.columns if c not in ("name", "type")]
    return m.join(kinds, [doc, "_id"]).select(*kept, F.col("name").alias("original"), F.coalesce("_c.canonical_name", "name").alias("name"), F.col("_id").alias("entity_id"), F.col("_type").alias("type"), aliases.alias("aliases"))


def retargeted(relations: DataFrame, groups: DataFrame, doc: str = "doc_id", target: str = "target") -> DataFrame:
    """Relations with ``target`` and ``target_id`` of the group that holds their target; others keep theirs and get none."""
    last = lookup(groups, doc).withColumn("_f", X.folded(F.col("alias"))).groupBy(doc, "_f").agg(F.max_by(F.struct("canonical_name", "canonical_id"), "ord").alias("_c"))
    r = relations.withColumn("_f", X.folded(F.col(target))).join(last, [doc, "_f"], "left")
    return r.withColumn(target, F.coalesce("_c.canonical_name", target)).withColumn("target_id", F.col("_c.canonical_id")).drop("_f", "_c")


_GROUPS = T.ArrayType(T.StructType([T.StructField("canonical_name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_GROUPS)
def answered_groups(responses: pd.Series) -> pd.Series:
    """Alias groups of a resolver's answers, in either of their two shapes; none where an answer can't be read."""
    from ..plans.parsing import json_object

    def of(text):
        try:
            value = json_object(text)
            listed = [(str(k), v) for k, v in (value.get("alias_groups") or {}).items()]
            for item in value.get("canonical_entities") or []:
                listed.append((str(item.get("canonical_name") or ""), item.get("aliases") or []))
            out = []
            for said, names in listed:
                aliases = [s for s in (str(n).strip() for n in names) if s]
                if aliases:
                    out.append({"canonical_name": said.strip() or aliases[0], "aliases": aliases})
            return out
        except (ValueError, TypeError, AttributeError):
            return []

    return responses.map(of)


def groups_of(responses: DataFrame, doc: str = "doc_id", response: str = "response") -> DataFrame:
    """(doc, ord, canonical_name, aliases) of one answer a document."""
    g = responses.select(doc, F.posexplode(answered_groups(response)).alias("ord", "g"))
    return g.select(doc, "ord", "g.canonical_name", "g.aliases")
