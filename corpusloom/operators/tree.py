"""Loops over the abstraction graph: rounds of research in windows, and the merge tree over windows in pairs.

Each step's answers come from a callable as tables; rows that name what isn't known are left out. Every step is a table
of its own: with a ``path`` a restart takes up after the last whole one and asks nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stored
from . import graph


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# ---------------------------------------------------------------- research
@dataclass
class Research:
    """objects after the last round; evidence, links and history of all rounds, with their round."""

    objects: DataFrame
    evidence: DataFrame
    links: DataFrame
    history: DataFrame


@dataclass
class Found:
    """A round's answers. evidence: window, ao_id, beat_ref, stance, why; links: window, from_ao, to_ao, link, why;
    updates: window, ord, ao_id, new_confidence, why; objects: window, ord and the columns of objects but ao_id."""

    evidence: DataFrame
    links: DataFrame
    updates: DataFrame
    objects: DataFrame


def research(objects: DataFrame, scenes: DataFrame, beats: DataFrame, ask: Callable[[int, DataFrame], Found], rounds: int = 2, path: str | None = None) -> Research:
    """Asks ``rounds`` times about the objects of that moment and applies what comes.

    objects: window, ao_id, scene_id, grounded_in, confidence, ...; scenes: window, scene_id; beats: window, ref. An answer
    speaks of its own window's objects only. A round sees the confidences and new objects of the rounds before, not its
    own. New objects must stand on their window's scenes and beats; their ids and ``provenance`` say window, round and
    place. Objects given have the provenance that they had, or none.
    """
    spark = objects.sparkSession
    kind = "struct<stage:string,round:int,window:int>"
    have = objects if "provenance" in objects.columns else objects.withColumn("provenance", F.lit(None).cast(kind))
    evidence, links, history = [], [], []
    for r in range(1, rounds + 1):
        now, made = have, []

        def found(now=now, made=made, r=r) -> Found:
            if not made:
                made.append(ask(r, now))
            return made[0]

        known = now.select("window", "ao_id")

        def said(df: DataFrame, *names: str, known=known) -> DataFrame:
            for n in names:
                df = df.join(known.withColumnRenamed("ao_id", n), ["window", n], "left_semi")
            return df

        stage = f"round-{r}"
        evidence.append(stored(spark, path, f"{stage}/evidence", lambda: said(found().evidence, "ao_id").select("window", "ao_id", "beat_ref", "stance", "why").withColumn("round", F.lit(r))))
        links.append(stored(spark, path, f"{stage}/links", lambda: said(found().links, "from_ao", "to_ao").select("window", "from_ao", "to_ao", "link", "why").withColumn("round", F.lit(r))))

        none = spark.createDataFrame([], "ao_id string, from_ao string, to_ao string")
        step = lambda: graph.researched(now, none.select("ao_id"), none.select("from_ao", "to_ao"), said(found().updates, "ao_id"), r)
        history.append(stored(spark, path, f"{stage}/history", lambda: step()[3]))

        def grown() -> DataFrame:
            # confidences by this round's stored history, so that a restart doesn't ask again for what it has
            last = history[-1].groupBy("ao_id").agg(F.max_by("to", "ord").alias("_new"))
            changed = now.join(last, "ao_id", "left").withColumn("confidence", F.coalesce("_new", "confidence")).select(*now.columns)
            new = graph.new_objects(found().objects, scenes, beats, r).withColumn("provenance", F.struct(F.lit("research").alias("stage"), F.lit(r).alias("round"), F.col("window").cast("int").alias("window")).cast(kind))
            return changed.unionByName(new.select(*(c for c in now.columns if c in new.columns)), allowMissingColumns=True)

        have = stored(spark, path, f"{stage}/objects", grown)
    return Research(have, _union(evidence), _union(links), _union(history))


# ---------------------------------------------------------------- merge tree
@dataclass
class Merged:
    """objects: all, with superseded_by and absorbed; links, duplicates and arcs of all levels, with their level; levels: what each did."""

    objects: DataFrame
    links: DataFrame
    duplicates: DataFrame
    arcs: DataFrame
    levels: DataFrame


@dataclass
class Joined:
    """A level's answers, each with doc and pair. links: ord, from_ao, to_ao, link, why; duplicates: ord, keep, drop; arcs: ord, name, subject, stages, summary."""

    links: DataFrame
    duplicates: DataFrame
    arcs: DataFrame


def merge_tree(objects: DataFrame, ask: Callable[[int, DataFrame, DataFrame], Joined], levels: int = 3, doc: str = "doc_id", path: str | None = None) -> Merged:
    """Merges a document's windows by twos, level by level: each level's pairs are asked about the objects that the one before left.

    objects: doc, window, label, ao_id, ...; windows without objects don't count. ``ask`` gets the level, the pairs (doc,
    pair, left_span, right_span, span) and their objects with ``pair`` and ``side`` (0 left, 1 right), and gives the
    answers. An odd last group goes up alone, unasked. An object dropped as a duplicate is marked, and left out of its
    pair from the next level on. Links and arcs may name any object of the document; an arc keeps the stages that exist,
    two at least, and has the span of its pair. Of several marks on an object the last by level, pair and ord counts.

    A group's place at level n is its window's place shifted right by n, so places are counted once, within a document,
    and every level deals out by document and pair.
    """
    spark = objects.sparkSession
    w = Window.partitionBy(doc)
    windows = objects.groupBy(doc, "window").agg(F.min("label").alias("label")).withColumn("_r", F.row_number().over(w.orderBy("window")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    windows = stored(spark, path, "windows", lambda: windows)
    ids = objects.select(doc, "ao_id").distinct()
    live = objects.join(windows.select(doc, "window", "_r", "_n"), [doc, "window"])
    links, duplicates, arcs, pairs_of = [], [], [], []

    def known(df: DataFrame, *names: str) -> DataFrame:
        for n in names:
            df = df.join(ids.withColumnRenamed("ao_id", n), [doc, n], "left_semi")
        return df

    for level in range(1, levels + 1):
        pair = F.shiftright("_r", level)
        whole = F.shiftleft(pair * 2 + 1, level - 1) < F.col("_n")
        side = F.shiftright("_r", level - 1) % 2
        end = lambda s, f: f(F.when(F.col("side") == s, F.struct("_r", "label")))["label"]
        spans = windows.where(whole).withColumn("pair", pair).withColumn("side", side).groupBy(doc, "pair").agg(end(0, F.min).alias("a"), end(0, F.max).alias("b"), end(1, F.min).alias("c"), end(1, F.max).alias("d"))
        span = lambda a, b: F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.concat_ws("..", F.substring_index(a, "..", 1), F.substring_index(b, "..", -1)))
        pairs = spans.select(doc, "pair", span("a", "b").alias("left_span"), span("c", "d").alias("right_span"), span("a", "d").alias("span"))
        if not pairs.head(1):
            break
        members = live.where(whole).withColumn("pair", pair).withColumn("side", side).drop("_r", "_n")
        made: list[Joined] = []

        def answer(level=level, pairs=pairs, members=members, made=made) -> Joined:
            if not made:
                made.append(ask(level, pairs, members))
            return made[0]

        def staged() -> DataFrame:
            a = answer().arcs.select(doc, "pair", "ord", "name", "subject", "summary", F.posexplode("stages").alias("_i", "ao_id"))
            a = a.join(ids, [doc, "ao_id"], "left_semi").groupBy(doc, "pair", "ord").agg(*(F.first(c).alias(c) for c in ("name", "subject", "summary")), F.array_sort(F.collect_list(F.struct("_i", "ao_id"))).alias("_s"))
            return a.where(F.size("_s") >= 2).join(pairs.select(doc, "pair", "span"), [doc, "pair"]).select(doc, "pair", "ord", "name", "subject", F.col("_s.ao_id").alias("stages"), "summary", F.lit(level).alias("level"), "span")

        at = f"level-{level}"
        links.append(stored(spark, path, f"{at}/links", lambda: known(answer().links, "from_ao", "to_ao").select(doc, "pair", "ord", "from_ao", "to_ao", "link", "why", F.lit(level).alias("level"), F.lit(f"merge-L{level}").alias("via"))))
        duplicates.append(stored(spark, path, f"{at}/duplicates", lambda: known(answer().duplicates.where("keep <> drop"), "keep", "drop").select(doc, "pair", "ord", "keep", "drop", F.lit(level).alias("level"))))
        arcs.append(stored(spark, path, f"{at}/arcs", staged))
        pairs_of.append(pairs.groupBy().agg(F.count(F.lit(1)).alias("merges")).withColumn("level", F.lit(level)))
        gone = duplicates[-1].select(doc, F.col("pair").alias("_pair"), F.col("drop").alias("ao_id")).distinct()
        live = stored(spark, path, f"{at}/live", lambda: live.withColumn("_pair", pair).join(gone, [doc, "_pair", "ao_id"], "left_anti").drop("_pair"))
    if not links:
        empty = spark.createDataFrame([], f"{doc} string, pair int, ord int, from_ao string, to_ao string, link string, why string, keep string, drop string, name string, subject string, stages array<string>, summary string, level int, span string, via string")
        return Merged(objects.withColumn("superseded_by", F.lit(None).cast("string")).withColumn("absorbed", F.array().cast("array<string>")), empty, empty, empty, empty.groupBy("level").count())
    every, dup, arc = _union(links), _union(duplicates), _union(arcs)
    order = F.struct("level", "pair", "ord")
    by = dup.groupBy(doc, F.col("drop").alias("ao_id")).agg(F.max_by("keep", order).alias("superseded_by"))
    took = dup.groupBy(doc, F.col("keep").alias("ao_id")).agg(F.array_sort(F.collect_list(F.struct("level", "pair", "ord", "drop"))).alias("_a")).select(doc, "ao_id", F.col("_a.drop").alias("absorbed"))
    out = objects.join(by, [doc, "ao_id"], "left").join(took, [doc, "ao_id"], "left").withColumn("absorbed", F.coalesce("absorbed", F.array().cast("array<string>")))
    count = lambda df, name: df.groupBy("level").agg(F.count(F.lit(1)).alias(name))
    stats = _union(pairs_of).join(count(every, "cross_links"), "level", "left").join(count(dup, "duplicates"), "level", "left").join(count(arc, "arcs"), "level", "left").na.fill(0)
    return Merged(out, every, dup, arc, stats.select("level", "merges", "cross_links", "duplicates", "arcs"))
