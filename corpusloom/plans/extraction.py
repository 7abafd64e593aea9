"""Documents to knowledge units: chunk, context, prompt, generate, parse and repair, fingerprint, canonicalize."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.lineage import cut
from ..operators import canonical as canon
from ..operators import chunking, entities, overlap
from . import models, parsing
from . import prompts as prompts_of


@dataclass(frozen=True)
class Config:
    mode: str = "parallel"
    chunk_words: int = 200
    context_words: int = 1000
    previous_units: int = 10
    parse_retries: int = 1
    permutations: int = 16
    max_tokens: int = 2500

    def __post_init__(self):
        if self.mode not in ("parallel", "sequential"):
            raise ValueError("mode is parallel or sequential")
        if self.chunk_words < 1 or min(self.context_words, self.previous_units, self.parse_retries) < 0:
            raise ValueError("chunk_words must be positive, the others not negative")


COMPACT = "Answer again with a shorter, complete JSON object."
#: stands for the units before a chunk in its prompt until they are there
EARLIER = "\x01earlier units\x01"
FALLBACK_WORDS = 350


def headed(documents: DataFrame, chunk_words: int) -> DataFrame:
    """(doc_id, title, abstract) as prompts show them: a text of several chunks without an abstract has its first words instead."""
    of = lambda c: F.col(c) if c in documents.columns else F.lit(None).cast("string")
    words = X.words(F.col("text"))
    first = X.bound(words, lambda w: F.when(F.size(w) > chunk_words, F.array_join(F.slice(w, 1, FALLBACK_WORDS), " ")))
    return documents.select("doc_id", of("title").alias("title"), F.coalesce(F.nullif(of("abstract"), F.lit("")), first).alias("abstract")).dropDuplicates(["doc_id"])


def prompts(documents: DataFrame, c: Config) -> DataFrame:
    """(doc_id, chunk_index, text, prompt) with title, abstract and neighbouring words as context."""
    rows = chunking.with_neighbours(documents, c.chunk_words, c.context_words).join(headed(documents, c.chunk_words), "doc_id")
    return rows.select("doc_id", "chunk_index", "text", prompts_of.unit(F.col("text"), F.col("before"), F.col("after"), F.col("title"), F.col("abstract")).alias("prompt"))


def generated(rows: DataFrame, model: models.Model, c: Config) -> DataFrame:
    """Units of prompts: what doesn't parse is asked again with a larger budget, at last recovered from its complete parts."""
    asked = cut(models.answer(rows, model, max_tokens=c.max_tokens).withColumn("unit", parsing.parsed("response")))
    done = asked.where("unit.error IS NULL")
    for i in range(c.parse_retries):
        failed = asked.where("unit.error IS NOT NULL").select(*rows.columns)
        again = failed.withColumn("prompt", F.concat(F.lit(COMPACT + "\n"), "prompt") if i + 1 == c.parse_retries else F.col("prompt"))
        parse = parsing.parsed_or_recovered if i + 1 == c.parse_retries else parsing.parsed
        asked = cut(models.answer(again, model, max_tokens=min(2 * c.max_tokens, 8192)).withColumn("unit", parse("response")))
        done = done.unionByName(asked.where("unit.error IS NULL"))
    return done.unionByName(asked.where("unit.error IS NOT NULL"))


def sequential(documents: DataFrame, model: models.Model, c: Config) -> DataFrame:
    """Units where each chunk's prompt holds the parsed units before it: an ordered loop within a document, parallel across documents.

    An answer that doesn't parse is asked for again with a larger budget, at last recovered from its complete parts; a
    chunk without a unit is not among those before.
    """
    chunks = chunking.split_text(documents, c.chunk_words).join(headed(documents, c.chunk_words), "doc_id")
    ask = lambda earlier: prompts_of.next_unit(F.col("text"), earlier, F.col("title"), F.col("abstract"))
    chunks = chunks.select("doc_id", "chunk_index", "text", ask(F.lit("")).alias("first"), ask(F.lit(EARLIER)).alias("later"))
    kind = chunks.schema["doc_id"].dataType
    fields = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("chunk_index int, text string, prompt string, response string, error string").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, past = [], []
        for r in pdf.sort_values("chunk_index").itertuples():
            known = past[-c.previous_units :] if c.previous_units else []
            prompt = r.later.replace(EARLIER, json.dumps(known, ensure_ascii=False)) if known else r.first
            response = error = None
            for attempt in range(c.parse_retries + 1):
                last = attempt == c.parse_retries
                try:
                    response = model.generate_batch([prompt if not attempt else f"{COMPACT}\n{prompt}" if last else prompt], c.max_tokens if not attempt else min(2 * c.max_tokens, 8192))[0]
                    error = None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                    continue
                made = parsing.unit(response, cut_allowed=last)
                if not made.get("error"):
                    past.append({"context_summary": made["context_summary"], "entities": [{k: e[k] for k in ("name", "entity_type", "aliases")} for e in made["entities"]]})
                    break
            out.append((r.doc_id, r.chunk_index, r.text, prompt, response, error))
        return pd.DataFrame(out, columns=fields.names)

    return chunks.groupBy("doc_id").applyInPandas(run, fields).withColumn("unit", parsing.parsed_or_recovered("response"))


def unit_context(units: DataFrame) -> DataFrame:
    """(doc_id, context): a document's units in order as compact JSON of what they say, without digests or places in the source."""
    pairs = lambda r: F.struct(r.predicate.alias("predicate"), r.target.alias("target"), F.try_parse_json(r.attributes).alias("attributes"))
    entity = lambda e: F.struct(e["name"].alias("name"), e.entity_type.alias("type"), F.try_parse_json(e.attributes).alias("attributes"), F.transform(e.relationships, pairs).alias("relationships"))
    said = F.struct(F.col("unit.context_summary").alias("context_summary"), F.transform("unit.entities", entity).alias("entities"))
    # one unit's JSON at a time, since what holds parsed JSON can't be sorted
    each = units.where("unit.error IS NULL").select("doc_id", "chunk_index", F.to_json(said, {"ignoreNullFields": "false"}).alias("j"))
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "j"))).alias("l"))
    return listed.select("doc_id", F.concat(F.lit("["), F.array_join("l.j", ","), F.lit("]")).alias("context"))


def extract(documents: DataFrame, model: models.Model, c: Config = Config()) -> DataFrame:
    """(doc_id, chunk_index, unit, sha256, sentence_minhash, error): one row per chunk. Documents of no words have none."""
    rows = sequential(documents, model, c) if c.mode == "sequential" else generated(prompts(documents, c), model, c)
    return rows.select("doc_id", "chunk_index", "unit", X.sha256(F.col("text")).alias("sha256"), overlap.token_minhash(c.permutations)("text").alias("sentence_minhash"), F.coalesce("error", "unit.error").alias("error"))


def mentions(units: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, pos, name, type): the entities of units in order."""
    e = units.select("doc_id", "chunk_index", F.posexplode("unit.entities").alias("i", "e"))
    return e.select("doc_id", "chunk_index", (F.col("chunk_index") * 100_000 + F.col("i")).alias("pos"), F.col("e.name").alias("name"), F.col("e.entity_type").alias("type"))


def resolver_answers(units: DataFrame, model: models.Model, max_tokens: int = 4096) -> DataFrame:
    """(doc_id, response, error): one answer a document to its names by chunk and the pairs of them that look alike. Documents without names aren't asked."""
    m = mentions(units)
    listed = units.where(F.size("unit.entities") > 0).select("doc_id", F.struct("chunk_index", F.col("unit.context_summary").alias("summary"), F.transform("unit.entities", lambda e: F.struct(e["name"].alias("name"), e.entity_type.alias("type"))).alias("entities")).alias("c"))
    names = listed.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("_names"))
    pairs = entities.alias_pairs(m, "doc_id").groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.array("left_name", "right_name")))).alias("_pairs"))
    none = F.lit("")
    asked = names.join(pairs, "doc_id", "left").select("doc_id", prompts_of.aliases(F.col("_names"), F.coalesce("_pairs", F.lit("[]")), none, none).alias("prompt"))
    return models.answer(asked, model, max_tokens=max_tokens).drop("prompt")


def canonical(units: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_id, canonical_name, type, aliases, mentions): a model's groups (doc_id, response), guarded by class, then names that are equal but for case and punctuation."""
    m = mentions(units)
    groups = canon.all_groups(m, None if answers is None else canon.groups_of(answers))
    named = canon.canonicalized(m, groups)
    return named.groupBy("doc_id", F.col("entity_id").alias("canonical_id")).agg(
        F.min_by("name", "pos").alias("canonical_name"), F.array_sort(F.collect_set("original")).alias("aliases"), F.min_by("type", "pos").alias("type"), F.count(F.lit(1)).alias("mentions")
    )


def judged(questions: DataFrame, model: models.Model, rounds: int = 4) -> DataFrame:
    """(document_id, question_index, condition, gold, pred): answers parsed from prompts, unparsed ones asked again up to ``rounds`` times.

    questions: document_id, question_index, condition, question, context, gold.
    """
    text = X.sanitized(F.format_string("Context: %s\nQuestion: %s\nAnswer:", F.coalesce("context", F.lit("")), "question"))
    base = questions.withColumn("prompt", text)
    keys = ["document_id", "question_index", "condition", "gold"]
    got = cut(models.answer(base, model).withColumn("pred", X.field_choice(F.col("response"))))
    done = got.where("pred IS NOT NULL").select(*keys, "pred")
    for i in range(rounds):
        open_ = got.where("pred IS NULL").select(*base.columns)
        if not open_.limit(1).count():
            return done
        got = cut(models.answer(open_.withColumn("prompt", F.concat("prompt", F.lit(" " * (i + 1)))), model).withColumn("pred", X.field_choice(F.col("response"))))
        done = done.unionByName(got.where("pred IS NOT NULL").select(*keys, "pred"))
    return done.unionByName(got.where("pred IS NULL").select(*keys, "pred"))
