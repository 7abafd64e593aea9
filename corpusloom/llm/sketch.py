"""Document fingerprints: the bottom-k sketch of a text's distinct shingle hashes, in DataFrame functions only.

A shingle is five consecutive words (a text of one to four words is one shingle). The sketch holds the k least of the
64-bit hashes, ascending. Sketches of parts merge into that of the whole; from two of them follow estimates of
resemblance (Jaccard), containment and the number of distinct shingles. With fewer than k shingles all are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
GAPS = "[\\x20\\x09-\\x0D]+"
ROWS_A_GROUP = 400
MOST_GROUPS = 20_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Array of the 64-bit hashes of all shingles, with repeats; empty for a text without words."""
    parts = F.filter(F.split(text, GAPS), lambda w: w != "")
    # each word's hash, then windows over the hashes: a shingle costs no string of its own
    return F.transform(F.array(F.transform(parts, lambda w: F.xxhash64(w))), lambda h: _windows(h, words))[0]


def _windows(h: Column, words: int) -> Column:
    count = F.size(h)
    full = F.transform(F.sequence(F.lit(0), count - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
    short = F.array(F.xxhash64(F.lit(-1), *(F.get(h, F.lit(j)) for j in range(words - 1))))
    return F.when(count >= words, full).when(count > 0, short).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Ascending array of at most k distinct hashes."""
    return F.slice(F.array_distinct(F.sort_array(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of the merged sketch that both hold. Two empty sketches give 1."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1.0) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's. An empty a is contained: 1."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(documents: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Each row with ``next_<column>``: the values of the row that follows by ascending ``key``; after the last, the first.

    Equal keys are ordered by the hash of their columns; null keys come first. Rows are cut into key ranges of about
    ROWS_A_GROUP rows by quantiles; the first row of a range is also sent to the range before, so that one shuffle of
    whole rows is all. Ranges that no key tells apart (repeated keys) stay together.
    """
    spark = documents.sparkSession
    ids = documents.select(F.col(key).cast("long").alias("_k"))
    head = ids.agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("keys")).first()
    groups = max(1, min(MOST_GROUPS, head.n // ROWS_A_GROUP))
    cuts = [] if head.keys == 0 or groups == 1 else ids.agg(F.percentile_approx("_k", [i / groups for i in range(1, groups)], max(10_000, 4 * groups))).first()[0]
    edges = sorted(set(cuts))
    ranges = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None]))], "_g int, _lo long, _hi long")
    row = documents.withColumn("_k", F.col(key).cast("long")).withColumn("_t", F.xxhash64(*columns))
    # a key's range without a search through all of them: ranges are listed under the stretch of keys that they touch
    if edges:
        low, width = edges[0], max(1, (edges[-1] - edges[0]) // len(edges) + 1)
        # greatest and least skip nulls, so a null key is told apart before them: it is listed with the lowest keys
        slot = F.when(F.col("_k").isNull(), -1).otherwise(F.greatest(F.lit(-1), F.least(F.lit(len(edges)), F.floor((F.col("_k") - low) / width)))).cast("int")
        of = lambda x: max(-1, min(len(edges), (x - low) // width))
        listed = [(s, i, lo, hi) for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])) for s in range(-1 if lo is None else of(lo), (len(edges) if hi is None else of(hi)) + 1)]
        ranges = spark.createDataFrame(listed, "_slot int, _g int, _lo long, _hi long")
        inside = (F.col("_lo").isNull() | (F.col("_k") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_k") <= F.col("_hi")))
        row = row.withColumn("_slot", slot)
        ranged = row.join(F.broadcast(ranges), "_slot").where(F.when(F.col("_k").isNull(), F.col("_g") == 0).otherwise(inside)).drop("_slot", "_lo", "_hi")
    else:
        ranged = row.withColumn("_g", F.lit(0))
    # the first key of each range that has rows, and the range before it; the first range follows the last
    keyed = ranged.groupBy("_g").agg(F.min("_k").alias("_first"), F.count_if(F.col("_k").isNull()).alias("_nulls"))
    seen = sorted((r._g, None if r._nulls else r._first) for r in keyed.collect())
    before = spark.createDataFrame([(g, first, seen[i - 1][0]) for i, (g, first) in enumerate(seen)], "_g int, _first long, _back int")
    sent = ranged.join(F.broadcast(before), "_g").withColumn("_is", F.col("_k").eqNullSafe(F.col("_first")))
    copies = sent.withColumn("_to", F.explode(F.when(F.col("_is"), F.array(F.struct(F.col("_g").alias("g"), F.lit(0).alias("late")), F.struct(F.col("_back").alias("g"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("_g").alias("g"), F.lit(0).alias("late"))))))
    order = Window.partitionBy("_to.g").orderBy("_to.late", F.col("_k").asc_nulls_first(), "_t")
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return copies.select(*(F.col(c) for c in documents.columns), F.col("_to.late").alias("_late"), *nexts).where("_late = 0").drop("_late")


def fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles, edited_containment.

    One row per row of ``documents``. The edited text ends, from the middle on, with the beginning of the next text. A
    null text counts as empty: its fingerprint is the empty string, and it resembles only another empty one, by 1. A
    table of one row follows itself.
    """
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = text.withColumn("own", sketch(F.col("text"), k))
    paired = with_next(own, ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_own", sketch(F.col("edited"), k))
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_own"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"),
        containment(F.col("own"), F.col("edited_own"), k).alias("edited_containment"),
    )
