"""Command line: extract, canonicalize and evaluate over files or tables, with the offline stub or a chat service; gate scenes or a graph."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lineage import cut
from .operators import evaluation
from .plans import extraction, gates, models
from .sources import documents


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("extract", "canonicalize", "evaluate"):
        v = verbs.add_parser(name)
        v.add_argument("input")
        v.add_argument("output")
        v.add_argument("--model", default="stub")
        v.add_argument("--url", action="append", default=[])
        v.add_argument("--key-variable", default="")
        v.add_argument("--mode", default="parallel", choices=("parallel", "sequential"))
        v.add_argument("--chunk-words", type=int)
        v.add_argument("--text-column", default="text")
        v.add_argument("--offset", type=int, default=0)
        v.add_argument("--limit", type=int)
    for name in ("gate-scenes", "gate-graph"):
        v = verbs.add_parser(name)
        v.add_argument("input")
        v.add_argument("output")
        v.add_argument("--verified", action="append", default=[])
        v.add_argument("--canary-emitted", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.verb.startswith("gate-"):
        return 0 if gates.run(spark, a.verb[5:], a.input, a.output, a.verified, a.canary_emitted) else 1
    model: models.Model = models.StubModel() if a.model == "stub" else models.EndpointModel(a.model, tuple(a.url), a.key_variable)
    if a.verb == "extract":
        rows = documents.selected(documents.read_documents(spark, a.input, a.text_column), a.offset, a.limit)
        words = a.chunk_words or (200 if a.mode == "sequential" else 500)
        extraction.extract(rows.withColumnRenamed("ord", "doc_id"), model, extraction.Config(mode=a.mode, chunk_words=words)).write.mode("overwrite").parquet(a.output)
    elif a.verb == "canonicalize":
        units = spark.read.parquet(a.input)
        extraction.canonical(units, extraction.resolver_answers(units, model)).write.mode("overwrite").parquet(a.output)
    else:
        docs = documents.read_evaluation(spark, a.input)
        known = extraction.extract(docs.select(F.col("document_id").alias("doc_id"), "text"), model, extraction.Config(mode=a.mode, chunk_words=a.chunk_words or 500))
        context = extraction.unit_context(cut(known)).withColumnRenamed("doc_id", "document_id")
        asked = docs.join(context, "document_id", "left").select("document_id", "text", "context", F.posexplode(F.arrays_zip("questions", "answers")).alias("question_index", "q"))
        arms = F.create_map(F.lit("no_context"), F.lit(""), F.lit("original"), F.coalesce("text", F.lit("")), F.lit("knowledge_units"), F.coalesce("context", F.lit("[]")))
        asked = asked.select("document_id", "question_index", F.col("q.questions").alias("question"), F.col("q.answers").alias("gold"), F.explode(arms).alias("condition", "context"))
        evaluation.summary(extraction.judged(asked, model)).write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
