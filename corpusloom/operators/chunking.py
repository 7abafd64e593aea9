"""Greedy sentence packing into chunks, with offsets, digests and neighbour context. One row in, one array out: no shuffle.

An expression that a lambda names is evaluated again at each step, so whatever is used more than once is bound by
``X.bound`` first: sentences are split once, folded once to the places where chunks begin, and cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _opens(sentences: Column, target: int) -> Column:
    """Places (from 1) of the sentences that begin a chunk."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("shut"), F.array().cast("array<int>").alias("opens"), F.lit(0).alias("at"))

    def step(state, s):
        n = F.size(F.split(s, " "))

        def after(n):
            big = n > target
            fresh = big | state.shut | (state.n + n > target)
            return F.struct(
                F.when(fresh, n).otherwise(state.n + n).alias("n"),
                big.alias("shut"),
                F.when(fresh, F.concat(state.opens, F.array(state["at"] + 1))).otherwise(state.opens).alias("opens"),
                (state["at"] + 1).alias("at"),
            )

        return X.bound(n, after)

    return F.aggregate(sentences, start, step, lambda s: s.opens)


def packed(sentences: Column, target: int) -> Column:
    """Array of (text, n) chunks of an array of sentences.

    A sentence of more than ``target`` words closes the open chunk and is cut every ``target`` words, its rest never
    joined; any other sentence closes the open chunk if both together exceed ``target``.
    """
    if target < 1:
        raise ValueError("target must be at least 1")

    def cut(w):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / target).cast("int")), lambda k: F.slice(w, k * target + 1, target))
        return F.transform(F.when(F.size(w) > target, parts).otherwise(F.array(w)), lambda x: F.struct(F.array_join(x, " ").alias("text"), F.size(x).alias("n")))

    def chunks(s):
        def made(opens):
            words = lambda a, i: F.split(F.array_join(F.slice(s, a, F.coalesce(F.get(opens, i + 1), F.size(s) + 1) - a), " "), " ")
            return F.flatten(F.transform(opens, lambda a, i: X.bound(words(a, i), cut)))

        return X.bound(_opens(s, target), made)

    return X.bound(sentences, chunks)


def _starts(chunks: Column) -> Column:
    """Words before each chunk, and in all."""
    return F.aggregate(chunks, F.array(F.lit(0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c.n)))


def split_text(documents: DataFrame, target: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, text, start_word, end_word): the chunks of each text with their offsets in words."""

    def placed(chunks):
        return X.bound(_starts(chunks), lambda at: F.transform(chunks, lambda c, i: F.struct(c.text.alias("text"), F.get(at, i).alias("a"), F.get(at, i + 1).alias("b"))))

    rows = documents.select(key, F.posexplode(X.bound(packed(X.sentences(F.col(text)), target), placed)).alias("chunk_index", "_p"))
    return rows.select(key, "chunk_index", F.col("_p.text").alias("text"), F.col("_p.a").alias("start_word"), F.col("_p.b").alias("end_word"))


def source_reference(chunks: DataFrame) -> DataFrame:
    """Offsets, word count and digest of each chunk."""
    return chunks.withColumn("word_count", F.col("end_word") - F.col("start_word")).withColumn("sha256", X.sha256(F.col("text")))


def with_neighbours(documents: DataFrame, target: int, context: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks with at most ``context`` words ``before`` and ``after`` them, cut at the text's ends."""
    if context < 0:
        raise ValueError("context must not be negative")

    def placed(chunks):
        every = F.flatten(F.transform(chunks, lambda c: F.split(c.text, " ")))

        def near(at):
            def inner(w):
                before = lambda a: F.array_join(F.slice(w, F.greatest(F.lit(0), a - context) + 1, F.least(a, F.lit(context))), " ")
                after = lambda b: F.array_join(F.slice(w, b + 1, context), " ")
                return F.transform(chunks, lambda c, i: F.struct(c.text.alias("text"), before(F.get(at, i)).alias("before"), after(F.get(at, i + 1)).alias("after")))

            return X.bound(every, inner)

        return X.bound(_starts(chunks), near)

    rows = documents.select(key, F.posexplode(X.bound(packed(X.sentences(F.col(text)), target), placed)).alias("chunk_index", "_p"))
    return rows.select(key, "chunk_index", "_p.text", "_p.before", "_p.after")


def abstract_fallback(documents: DataFrame, target: int = 200, words: int = 350, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first ``words`` words as an abstract where a text has more than one chunk; else empty. With its digest, empty for none."""
    several = X.bound(X.sentences(F.col(text)), lambda s: F.size(packed(s, target)) > 1)
    lead = F.when(several, F.array_join(F.slice(X.words(F.col(text)), 1, words), " ")).otherwise("")
    return documents.select(key, F.get(F.transform(F.array(lead), lambda a: F.struct(a.alias("abstract"), F.when(a == "", "").otherwise(X.sha256(a)).alias("abstract_sha256"))), 0).alias("_a")).select(key, "_a.*")
