"""What of a scene's source must come back in its unit: numbers, speakers' names and places, less what is typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import checks, scenes

# fixed values: what counts as a number, a composite one, a line of production furniture, and a name
NUMBER = r"\b\d[\d,.:]*\b"
COMPOSITE = r"\b\d[\d]*(?:[-/:.]\d+)+\b"
FURNITURE = r"(?i)^\s*(?:\d+\s*OMITTED\s*\d*|OMITTED\s*\d*|\(?\s*(?:CONTINUED|MORE)\s*\)?\s*\d*|[-\s]*Rev\.?\s.*|\d+[A-Z]?\.?)\s*$"
NAME = r"^[A-Za-z][A-Za-z .'#-]*$"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ROLES = (
    "man", "woman", "boy", "girl", "cop", "big cop", "guard", "officer", "voice", "lieutenant", "pilot", "priestess", "operator", "agent", "guard #4", "fedex guy", "spoon boy", "monitor", "child", "driver", "soldier", "nurse", "doctor", "clerk",
)
LEAST_RECALL = 0.95


def requirable_name(speaker: Column) -> Column:
    """Whether a speaker's cue is a name: one or two words of letters, no role, no cut-off end."""
    s = F.trim(X.text_of(speaker))
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return s.rlike(NAME) & ~s.rlike(r"[.-]$") & (words <= 2) & ~X.folded(s).isin(*ROLES)


def content_lines(text: Column, stamps: Column) -> Column:
    """Lines after the first (or the only one) without furniture and stamped lines, each without the number it is wrapped in."""
    lines = F.split(X.text_of(text), LINE_ENDS)
    body = X.bound(lines, lambda x: F.when(F.size(x) > 1, F.slice(x, 2, F.size(x) - 1)).otherwise(x))
    kept = F.filter(body, lambda line: ~line.rlike(FURNITURE) & ~F.exists(stamps, lambda s: F.contains(line, s)))
    return F.transform(kept, scenes.unwrapped)


def requirable_numbers(text: Column, kind: Column, stamps: Column) -> Column:
    """Distinct numbers that a unit must hold, composites whole; none for what stands before the first scene."""

    def of(t):
        composites = F.regexp_extract_all(t, F.lit(COMPOSITE), F.lit(0))
        plain = F.regexp_extract_all(F.regexp_replace(t, COMPOSITE, " "), F.lit(NUMBER), F.lit(0))
        return F.array_union(composites, plain)

    return F.when(F.coalesce(kind, F.lit("")) == "PRE", F.array().cast("array<string>")).otherwise(X.bound(F.array_join(content_lines(text, stamps), "\n"), of))


def number_satisfied(required: Column, numbers: Column) -> Column:
    """Whether numbers hold the required one, or all parts of it where it has several."""
    parts = F.filter(F.split(required, "[-/:.]"), lambda p: p != "")
    return F.array_contains(numbers, required) | X.bound(parts, lambda p: (F.size(p) > 1) & F.forall(p, lambda x: F.array_contains(numbers, x)))


def recalled(source: DataFrame, blobs: DataFrame) -> DataFrame:
    """(scene_id, kind, value, hit): every requirable number, name and place, and whether the scene's unit holds it.

    source: scene_id, text, kind, location, speakers, stamps; blobs: scene_id, blob (all that the unit says). Scenes
    without a unit are left out.
    """
    b = blobs.select("scene_id", X.check_tokens(F.col("blob")).alias("_t"), F.regexp_extract_all(X.text_of(F.col("blob")), F.lit(NUMBER), F.lit(0)).alias("_n"))
    s = source.join(b, "scene_id")
    any_word = lambda v: F.arrays_overlap(X.check_tokens(v), F.col("_t"))
    numbers = s.select("scene_id", "_n", F.explode(requirable_numbers(F.col("text"), F.col("kind"), F.col("stamps"))).alias("value"))
    names = s.select("scene_id", "_t", F.explode(F.array_distinct("speakers")).alias("value")).where(requirable_name(F.col("value")) & (F.size(X.check_tokens(F.col("value"))) > 0))
    places = s.where(X.text_of(F.col("location")) != "").select("scene_id", "_t", F.col("location").alias("value"))
    return (
        numbers.select("scene_id", F.lit("number").alias("kind"), "value", number_satisfied(F.col("value"), F.col("_n")).alias("hit"))
        .unionByName(names.select("scene_id", F.lit("name").alias("kind"), "value", any_word(F.col("value")).alias("hit")))
        .unionByName(places.select("scene_id", F.lit("location").alias("kind"), "value", any_word(F.col("value")).alias("hit")))
    )


def recall_rates(rows: DataFrame) -> DataFrame:
    """(kind, total, recall) of ``recalled``."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("hit").cast("double")).alias("recall"))


def fidelity(rows: DataFrame, drifted: DataFrame, least: float = LEAST_RECALL) -> DataFrame:
    """C3 whole: drifted numbers (scene_id, number, original) fail, whatever else is missing warns."""
    rate = lambda k: F.avg(F.when(F.col("kind") == k, F.col("hit").cast("double")))
    figures = rows.agg(F.coalesce(rate("number"), F.lit(1.0)).alias("number_recall"), rate("name").alias("name_recall"), rate("location").alias("location_recall"), F.count_if(~F.col("hit")).alias("missed"))
    figures = figures.crossJoin(F.broadcast(drifted.agg(F.count(F.lit(1)).alias("numbers_drifted"))))  # one row by one row
    lost = rows.where(~F.col("hit")).select(F.concat_ws(" ", "scene_id", "kind", "value").alias("v"))
    wrong = drifted.select(F.concat_ws(" ", "scene_id", F.lit("drift"), "number").alias("v"))
    return checks.result(lost.union(wrong), "C3", "fact fidelity", True, fail=F.col("numbers_drifted") > 0, warn=(F.col("number_recall") < least) | (F.col("missed") > 0), detail=figures)
