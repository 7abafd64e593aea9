"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal token counts.

Slot t of the schedule is the golden-ratio point frac(t * phi) mapped through the cumulative shares of the sources.
The slots of a source are ranked; rank r takes block r modulo the source's number of blocks, so a source is passed
through in order, and again where its target exceeds its size. A source's blocks cut the sequence of its words, with
the documents in hashed order, into equal parts of at most ``block`` words and at most 1 / CUTS of the source, and a
source has slots by its target over the words of its blocks; a long document spans blocks. Ranks and word positions come from
counts in small buckets and their prefix sums, so that no task holds all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, materialize

WORD_GAPS = "[\\x20\\x09-\\x0D]+"
REPEAT = 3
LARGEST_BLOCK = 4096
CUTS = 256
GOLDEN = 11400714819323198485  # 2**64 / golden ratio, odd
LOW32 = 0xFFFFFFFF


def word_count(text: Column) -> Column:
    """Number of maximal runs without space and tab to carriage return; 0 for null and empty texts."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAPS)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, weight, target): one row per source, all in double and long.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Shares of the total stop at REPEAT times a
    source's size and the excess is shared again by weight: with sources ordered by size / weight, the capped ones come
    first, and the level of the others is what remains over their weight.
    """
    totals = sized.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    weighed = totals.withColumn("weight", (F.lit(1) + (F.row_number().over(order) - 1) % 3).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(source).isNull(), F.col(source))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    limit = REPEAT * F.col("source_size").cast("double")
    levels = (
        weighed.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_full", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("_done", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_done")))
        .withColumn("_rank", F.row_number().over(ratio))
        .withColumn("_first", F.min(F.when(F.col("_level") * F.col("weight") <= limit, F.struct("_rank", "_level"))).over(everything))
    )
    free = F.col("_rank") >= F.col("_first._rank")
    return levels.select(source, "source_size", "weight", F.when(free, F.col("_first._level") * F.col("weight")).otherwise(limit).alias("target"))


def _point(slot: Column) -> Column:
    """frac(slot * golden ratio) as a double in [0, 1), exact in 64-bit integers: the product's high and low halves apart."""
    high, low = GOLDEN >> 32, GOLDEN & LOW32
    s1, s0 = F.shiftrightunsigned(slot, 32), slot.bitwiseAND(F.lit(LOW32))
    cross = (s1 * F.lit(low)).bitwiseAND(F.lit(LOW32)) + (s0 * F.lit(high)).bitwiseAND(F.lit(LOW32)) + F.floor((s0.cast("decimal(20,0)") * F.lit(low).cast("decimal(20,0)") / F.lit(1 << 32).cast("decimal(20,0)"))).cast("long")
    return cross.bitwiseAND(F.lit(LOW32)).cast("double") / F.lit(float(1 << 32))


def block_words(total: int) -> int:
    """About a million slots; at LARGEST_BLOCK words a block, more slots as the corpus grows."""
    return max(1, min(LARGEST_BLOCK, total >> 20))


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes) for every row of ``documents``, in no order.

    ``taken`` counts the words that the mix takes of the row, with repeats; ``passes`` is taken / size. A null text has
    size 0. Repeated rows are told apart by nothing but their place among equals, and share out what equals take. An
    empty table gives an empty result; where all sizes are 0 the targets are 0.
    """
    spark = documents.sparkSession
    sized = materialize(
        documents.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key)).alias("_h"),
        ),
        "mix-sizes",
    )
    targets = cut = None
    try:
        targets = materialize(source_targets(sized), "mix-targets")
        head = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n")).first()
        rows = sized.count()
        # equal cuts, so that every block of a source holds as many words, to one
        size = F.col("source_size")
        most = F.least(F.lit(block_words(head.words)), F.greatest(F.lit(1), F.floor(size / CUTS))).cast("long")
        cut = materialize(targets.where("source_size > 0").withColumn("_blocks", F.ceil(size / most).cast("long")), "mix-cuts")
        buckets = max(64, rows // 256)

        # where each document stands among the words of its source
        placed = sized.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("long"))
        sums = placed.groupBy("source", "_b").agg(F.sum("size").alias("_words"))
        earlier = _prefix(sums, "_words", buckets).select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "_before")
        inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = (
            placed.join(earlier, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")), "left")
            .withColumn("_from", F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .select("doc_id", "source", "size", "_from")
        )

        # the schedule: how often each block of a source is taken
        times = _schedule(spark, cut)
        few = cut.select(F.col("source").alias("_cs"), F.col("source_size").alias("_all"), "_blocks")
        full = placed.where("size > 0").join(F.broadcast(few) if head.n <= 10_000 else few, F.col("source").eqNullSafe(F.col("_cs")))
        # block i of n holds the words from i * all / n on, rounded down; in whole numbers, since products pass 2**53
        first, last = F.expr("((_from + 1) * _blocks - 1) div _all"), F.expr("((_from + size) * _blocks - 1) div _all")
        spans = full.select("doc_id", "source", "size", "_from", "_all", "_blocks", F.explode(F.sequence(first, last)).alias("_block"))
        at, to = F.expr("(_block * _all) div _blocks"), F.expr("((_block + 1) * _all) div _blocks")
        spans = spans.withColumn("_part", F.least(F.col("_from") + F.col("size"), to) - F.greatest(F.col("_from"), at))
        taken = (
            spans.join(times, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("_block") == F.col("_tb")), "left")
            .groupBy("doc_id", "source", "size", "_from")
            .agg(F.sum(F.col("_part") * F.coalesce(F.col("_times"), F.lit(0))).alias("taken"))
        )
        whole = taken.select("doc_id", "source", "size", "taken").unionByName(placed.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
        known = targets.select(F.col("source").alias("_ks"), "source_size", "target")
        result = whole.join(F.broadcast(known) if head.n <= 10_000 else known, F.col("source").eqNullSafe(F.col("_ks")), "left")
        return materialize(
            result.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken", F.coalesce(F.try_divide("taken", "size"), F.lit(0.0)).alias("passes")),
            "mix-result",
        )
    finally:
        for used in (sized, targets, cut):
            if used is not None:
                discard(used)


def _prefix(sums: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds ``_before``: the sum over the source's lower buckets. Buckets are grouped by a thousand to keep windows short."""
    chunk = F.floor(F.col("_b") / 1000).cast("long")
    grouped = sums.withColumn("_c", chunk)
    outer = grouped.groupBy("source", "_c").agg(F.sum(value).alias("_cw"))
    chunks = outer.select(
        F.col("source").alias("_cs"),
        F.col("_c").alias("_cc"),
        F.coalesce(F.sum("_cw").over(Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    near = Window.partitionBy("source", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        grouped.withColumn("_in", F.coalesce(F.sum(value).over(near), F.lit(0)))
        .join(chunks, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_c") == F.col("_cc")))
        .withColumn("_before", F.col("_base") + F.col("_in"))
    )


def _schedule(spark, cut: DataFrame) -> DataFrame:
    """(_ts, _tb, _times): the source's block and how many slots fell to it."""
    wanted = cut.where("target > 0").withColumn("_slots", F.col("target") * F.col("_blocks") / F.col("source_size"))
    slots = round(wanted.agg(F.coalesce(F.sum("_slots"), F.lit(0.0))).first()[0])
    # cumulative shares: the sources are few beside the slots, and each slot finds its source by a range of the unit line
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    shares = wanted.select(
        "source",
        "_blocks",
        F.sum("_slots").over(order).alias("_to"),
        F.sum("_slots").over(Window.partitionBy(F.lit(0))).alias("_all"),
        "_slots",
    )
    line = shares.select("source", "_blocks", ((F.col("_to") - F.col("_slots")) / F.col("_all")).alias("_lo"), (F.col("_to") / F.col("_all")).alias("_hi"))
    cells = 4096
    ranges = line.select("*", F.explode(F.sequence(F.floor(F.col("_lo") * cells).cast("long"), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)).cast("long"))).alias("_cell"))
    points = spark.range(slots).withColumn("_u", _point(F.col("id"))).withColumn("_cell", F.floor(F.col("_u") * cells).cast("long"))
    dealt = points.join(ranges, "_cell").where("_u >= _lo AND _u < _hi").select("id", "source", "_blocks")
    # rank per source: counts per run of slots, their prefix sums, and the place within the run
    run = dealt.withColumn("_b", F.floor(F.col("id") / 1024).cast("long"))
    counts = run.groupBy("source", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = _prefix(counts, "_n", slots // 1024 + 1).select(F.col("source").alias("_ps"), F.col("_b").alias("_pb"), "_before")
    ranked = run.join(before, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb"))).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("source", "_b").orderBy("id")) - 1
    )
    return (
        ranked.where(F.col("_rank") < REPEAT * F.col("_blocks"))
        .groupBy(F.col("source").alias("_ts"), (F.col("_rank") % F.col("_blocks")).alias("_tb"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix takes them: each row as many times as its words are taken, to the nearest whole number.

    Only documents at the edge of a block are taken in part. A text without words is taken not at all. Rows that repeat a
    key with as many words share what their key takes.
    """
    d, s, times, size, copy = free_names(documents, "_d", "_s", "_times", "_size", "_copy")
    taken = mix(documents).where("size > 0").groupBy("doc_id", "size").agg(F.round(F.avg("passes")).cast("int").alias(times)).where(F.col(times) > 0)
    taken = taken.select(F.col("doc_id").alias(d), F.col("size").alias(s), times)
    rows = documents.withColumn(size, word_count(F.col("text")))
    met = rows.join(taken, rows["doc_id"].eqNullSafe(taken[d]) & (rows[size] == taken[s]))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*documents.columns)
