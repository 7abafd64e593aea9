"""Stages that ask a model again: windows with a reason for their rejection, seams, restated fields, the editor's running map, the test suite's word."""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.lineage import cut
from ..operators import checks, graph, overlap, units
from . import models, parsing, prompts, schemas

ATTEMPTS = 2
FLANK = 3


def extracted(windows: DataFrame, model: models.Model, key: str = "window", max_tokens: int = 12_288) -> DataFrame:
    """(key, scene_id, unit, error): the units of windows (key, scene_ids, prompt) as JSON, one row each; a window that fails twice is one row with its error.

    The second attempt says why the first was rejected. A canary's scenes are expected to give nothing.
    """

    def ask(prompt: str, scene_ids: list[str]) -> tuple[list[dict], str | None]:
        said = ""
        for _ in range(ATTEMPTS):
            try:
                value = parsing.json_object(model.generate_batch([prompt + said], max_tokens)[0])
                found = value.get("knowledge_units")
                if not isinstance(found, list):
                    raise ValueError("no list of knowledge_units")
                got = sorted(str(u.get("scene_id")) for u in found if isinstance(u, dict))
                if got != sorted(scene_ids):
                    raise ValueError(f"scenes {got} instead of {sorted(scene_ids)}")
                return found, None
            except Exception as e:
                reason = f"{type(e).__name__}: {e}"
                said = f"\n\nYour answer before this one was rejected: {reason}"
        return [], reason

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, ids, prompt in zip(frame[key], frame["scene_ids"], frame["prompt"]):
                found, error = ask(prompt, list(ids))
                rows += [(k, None, None, error)] if error else [(k, u["scene_id"], json.dumps(u, ensure_ascii=False), None) for u in found]
            yield pd.DataFrame(rows, columns=[key, "scene_id", "unit", "error"])

    fields = T.StructType([windows.schema[key], *(T.StructField(c, T.StringType()) for c in ("scene_id", "unit", "error"))])
    return windows.select(key, "scene_ids", "prompt").mapInPandas(run, fields)


def canary_emitted(canaries: DataFrame, model: models.Model, max_tokens: int = 12_288) -> int:
    """How many units the model gives for windows (prompt) without a target; an answer that can't be read gives none."""
    listed = F.from_json(F.get_json_object("response", "$.knowledge_units"), "array<string>")
    return models.answer(canaries, model, max_tokens=max_tokens).select(F.sum(F.coalesce(F.size(listed), F.lit(0)).cast("long"))).first()[0] or 0


def seam_answers(shown: DataFrame, model: models.Model, doc: str = "doc_id", flank: int = FLANK) -> DataFrame:
    """(doc, left_window, right_window, response, error): what the model says of each pair of neighbouring windows.

    shown: doc, window, scene_index, digest of the units. Of each window only ``flank`` units at the seam are shown; a pair
    with an empty side doesn't exist.
    """
    per = shown.groupBy(doc, "window").agg(F.array_sort(F.collect_list(F.struct("scene_index", "digest"))).getField("digest").alias("_d"))
    pairs = units.seams(per.select(doc, "window"), doc)
    last = per.select(doc, F.col("window").alias("left_window"), F.array_join(F.slice("_d", -F.least(F.lit(flank), F.size("_d")), flank), "\n\n").alias("_l"))
    first = per.select(doc, F.col("window").alias("right_window"), F.array_join(F.slice("_d", 1, flank), "\n\n").alias("_r"))
    asked = pairs.join(last, [doc, "left_window"]).join(first, [doc, "right_window"]).withColumn("prompt", prompts.seam(F.col("_l"), F.col("_r")))
    return models.answer(asked.select(doc, "left_window", "right_window", "prompt"), model).drop("prompt")


def seam_merges(answers: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(alias merges (doc, alias, canonical), context fixes (doc, scene_id, field, replacement)) of parsed answers; merges are resolved along their chains."""
    kind = "struct<alias_merges:array<struct<keep:string,merge:array<string>>>,context_fixes:array<struct<scene_id:string,field:string,replacement:string>>>"
    a = answers.select(doc, F.from_json("response", kind).alias("p"))
    merges = a.select(doc, F.explode("p.alias_merges").alias("m")).select(doc, F.explode("m.merge").alias("alias"), F.col("m.keep").alias("canonical")).where("alias <> canonical")
    fixes = a.select(doc, F.explode("p.context_fixes").alias("f")).select(doc, "f.*").where(F.length(F.trim("replacement")) >= 20)
    return merges, fixes


def restated(fields: DataFrame, source: DataFrame, model: models.Model, rounds: int = 3, fail_at: int = overlap.FAIL, keys: tuple[str, ...] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """(fields, (round, flagged)): fields (path, text) whose runs of the source are restated until none fails, at most ``rounds`` times.

    All flagged fields go to the model, with their own text and the length of the run; the source never does. A
    restatement of fewer than ten characters leaves the field as it was.
    """
    report = []
    for i in range(rounds):
        runs = checks.source_runs(fields, source)
        bad = cut(fields.join(runs.where((F.col("run") >= fail_at) & (F.col("novel") >= checks.NOVEL)).select("path", "run"), "path"))
        n = bad.count()
        report.append((i + 1, n))
        if not n:
            break
        asked = models.answer(bad.withColumn("prompt", prompts.restate(F.col("text"), F.col("run"))), model, max_tokens=1024)
        fields = cut(graph.restated(fields, asked.select(*keys, F.get_json_object("response", "$.restated").alias("restated")), list(keys)))
    return fields, fields.sparkSession.createDataFrame(report, "round int, flagged long")


def edited(names: list[str], model: models.Model, batch: int = 40, max_tokens: int = 4096) -> dict[str, str]:
    """variant -> canonical of sorted names in batches, each of which sees what the batches before it settled.

    One after the other by design: a batch uses the forms that others established. An answer that can't be read is passed
    over. The names are those of one document.
    """
    settled: dict[str, str] = {}
    ordered = sorted(set(filter(None, names)))
    for at in range(0, len(ordered), batch):
        part = ordered[at : at + batch]
        prompt = "Give spellings of one name one canonical form. Forms that are established already stay.\n\nNAMES:\n" + json.dumps(part, ensure_ascii=False) + "\n\nESTABLISHED:\n" + json.dumps(settled, ensure_ascii=False)
        try:
            value = parsing.json_object(model.generate_batch([prompt], max_tokens)[0])
        except Exception:
            continue
        for group in value.get("canonical_map") or []:
            to = str(group.get("canonical") or "").strip()
            settled |= {v: to for v in (str(x).strip() for x in group.get("variants") or []) if to and v and v != to}
    return settled


def edited_names(names: DataFrame, model: models.Model, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """(doc, alias, canonical): the editor's map of each document, chains not yet followed; a document's names meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = edited(pdf[name].tolist(), model)
        made = {doc: [pdf[doc].iloc[0]] * len(found), "alias": list(found), "canonical": list(found.values())}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in made.items()})

    kind = names.schema[doc].dataType.simpleString()
    return names.select(doc, name).distinct().groupBy(doc).applyInPandas(run, f"{doc} {kind}, alias string, canonical string")


def answered(fields: DataFrame, schema: schemas.Schema, response: str = "response") -> DataFrame:
    """``fields`` with ``faults``: where each answer departs from a schema; an answer without JSON has one."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return schemas.faults(parsing.json_object(t), schema)
            except ValueError as e:
                return [f"$: {e}"]

        return texts.map(one)

    return fields.withColumn("faults", found(X.text_of(F.col(response))))


def verified_checks(tests: str, ids: Callable[[str], list[str]] | None = None, timeout: float = 1800) -> list[str]:
    """Ids of the checks whose negative cases pass, by running their tests; none if the run fails in any way."""
    try:
        run = subprocess.run([sys.executable, "-m", "pytest", tests, "-q", "-p", "no:cacheprovider", "-rA"], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return []
    if run.returncode:
        return []
    import re

    find = ids or (lambda out: sorted({m.upper() for m in re.findall(r"PASSED \S*::test_([cg]\d)\b", out)} | {m.upper() for line in re.findall(r"PASSED \S*::test_((?:[cg]\d_?)+)", out) for m in line.split("_") if m}))
    return find(run.stdout)
