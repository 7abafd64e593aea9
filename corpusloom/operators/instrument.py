"""The multiple-choice instrument: a stratified sample of scenes, questions from answers, leaks of the source, arms and contexts."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import cut
from . import overlap

QUESTIONS = "array<struct<question:string,options:array<string>,correct_index:int,fact_type:string>>"
SAMPLE_SEED = 20260819
LEAST_WORDS = 20
LEAK = 6


def drawn(scenes: list[tuple[int, int]], count: int, seed: int = SAMPLE_SEED) -> list[int]:
    """Indexes of at most ``count`` of the scenes (index, words) that are long enough, in order.

    Nine strata: every third by place, and of those every third by length. They give in turn one scene each, drawn from
    what they have left, until enough are drawn or all are empty.
    """
    long = sorted(s for s in scenes if s[1] >= LEAST_WORDS)
    strata = [sorted(long[i::3], key=lambda s: s[1])[j::3] for i in range(3) for j in range(3)]
    rng, picked = random.Random(seed), []
    while any(strata) and len(picked) < count:
        for left in strata:
            if left and len(picked) < count:
                picked.append(left.pop(rng._randbelow(len(left))))
    return sorted(i for i, _ in picked)


def sampled_scenes(scenes: DataFrame, count: int = 25, seed: int = SAMPLE_SEED, doc: str = "doc_id") -> DataFrame:
    """The scenes (doc, scene_index, word_count, ...) that ``drawn`` picks of each document. Only two numbers a scene meet in a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({doc: pdf[doc].iloc[0], "scene_index": drawn(list(zip(pdf["scene_index"], pdf["word_count"])), count, seed)})

    kind = f"{doc} {scenes.schema[doc].dataType.simpleString()}, scene_index {scenes.schema['scene_index'].dataType.simpleString()}"
    return scenes.join(scenes.select(doc, "scene_index", "word_count").groupBy(doc).applyInPandas(run, kind), [doc, "scene_index"], "left_semi")


def valid_question(options: Column, index: Column) -> Column:
    """Four options that differ once trimmed and folded, and the index of one of them."""
    differ = F.size(F.array_distinct(F.transform(options, lambda o: X.folded(F.trim(o))))) == 4
    return F.coalesce((F.size(options) == 4) & differ & index.between(0, 3), F.lit(False))


def questions_of(answers: DataFrame, scene: str = "scene_id", answer: str = "answer") -> DataFrame:
    """(scene, question_id, question, options, correct_index, fact_type): the valid questions of JSON answers, numbered with the others."""
    listed = F.from_json(F.get_json_object(answer, "$.questions"), QUESTIONS)
    q = answers.select(scene, F.posexplode(listed).alias("_i", "_q")).where(valid_question(F.col("_q.options"), F.col("_q.correct_index")))
    return q.select(
        scene,
        F.format_string("%s-q%d", F.col(scene), F.col("_i") + 1).alias("question_id"),
        F.trim("_q.question").alias("question"),
        F.transform("_q.options", lambda o: F.trim(o)).alias("options"),
        "_q.correct_index",
        F.coalesce("_q.fact_type", F.lit("who_did_what")).alias("fact_type"),
    )


def leaking(questions: DataFrame, source: DataFrame, least: int = LEAK) -> DataFrame:
    """(question_id, run_words) of questions that share a run of ``least`` words with the source (source_id, text), in themselves or an option."""
    parts = questions.select("question_id", F.posexplode(F.concat(F.array("question"), "options")).alias("_i", "text"))
    parts = parts.select(F.concat_ws("#", "question_id", F.col("_i").cast("string")).alias("part"), "question_id", "text")
    runs = overlap.shared_runs(parts, source, "part", "source_id", least)
    longest = runs.join(parts.select("part", "question_id"), "part").groupBy("question_id").agg(F.max("run").alias("run"))
    return longest.select("question_id", F.least("run", F.lit(20)).cast("int").alias("run_words"))


def without_leaks(questions: DataFrame, source: DataFrame, again: Callable[[DataFrame], DataFrame], rounds: int = 3, scene: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """(questions that quote nothing, (question_id, run_words) of those dropped).

    Scenes with a leaking question get new questions by ``again`` (scene ids to questions), at most ``rounds`` times; what
    leaks then is dropped.
    """
    questions = cut(questions)
    for _ in range(rounds):
        bad = cut(questions.join(leaking(questions, source), "question_id", "left_semi").select(scene).distinct())
        if not bad.limit(1).count():
            break
        questions = cut(questions.join(bad, scene, "left_anti").unionByName(again(bad)))
    dropped = cut(leaking(questions, source))
    return questions.join(dropped, "question_id", "left_anti"), dropped


def contexts(questions: DataFrame, units: DataFrame, arm: str, radius: int = 2, doc: str = "doc_id") -> DataFrame:
    """``questions`` (doc, scene_id, ...) with ``context``: nothing, their own scene's digest, those ``radius`` places around it, or all of the document.

    units: doc, scene_id, scene_index, digest. A scene that the units lack gets an empty context of its own.
    """
    if arm == "none":
        return questions.withColumn("context", F.lit(""))
    if arm == "whole":
        every = units.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(F.struct("scene_index", "digest"))).getField("digest"), "\n\n").alias("context"))
        return questions.join(every, doc, "left").withColumn("context", F.coalesce("context", F.lit("")))
    from .scenes import neighbourhood

    near = neighbourhood(units, doc, "scene_index", "digest", radius if arm == "near" else 0)
    return questions.join(near.select(doc, "scene_id", F.array_join("near", "\n\n").alias("context")), [doc, "scene_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))
