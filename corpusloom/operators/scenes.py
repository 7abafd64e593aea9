"""Ordered narrative: windows, neighbours, chains, numbers and the coverage of a source by its scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: numbers with their composites, and dates as a draft's revisions are stamped
NUMBER = r"\d+(?:[-/:.]\d+)*"
STAMP = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"


def chain(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """preceded_by and followed_by: the keys before and after in order."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("preceded_by", F.lag(key).over(w)).withColumn("followed_by", F.lead(key).over(w))


def previous(df: DataFrame, group: str, order: str, value: str, n: int, out: str = "previous") -> DataFrame:
    """The values of the n rows before, oldest first."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-n, -1) if n else None
    return df.withColumn(out, F.collect_list(value).over(w) if n else F.array().cast("array<string>"))


def neighbourhood(df: DataFrame, group: str, order: str, value: str, radius: int = 2, out: str = "near") -> DataFrame:
    """The values of the rows at most ``radius`` places away, itself included, in order."""
    return df.withColumn(out, F.collect_list(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(-radius, radius)))


def greedy_windows(df: DataFrame, group: str, order: str, size: str, target: int, most: int) -> DataFrame:
    """(group, order, size, window): a window closes before the row that would exceed ``target`` in sum or ``most`` in number."""
    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("_l"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("w"), F.array().cast("array<int>").alias("out"))

    def step(state, x):
        shut = (state.n > 0) & ((state["sum"] + x.s > target) | (state.n >= most))
        w = F.when(shut, state.w + 1).otherwise(state.w)
        return F.struct(F.when(shut, x.s).otherwise(state["sum"] + x.s).alias("sum"), F.when(shut, 1).otherwise(state.n + 1).alias("n"), w.alias("w"), F.concat(state.out, F.array(w)).alias("out"))

    marked = listed.withColumn("_w", F.aggregate("_l", start, step, lambda s: s.out))
    return marked.select(group, F.explode(F.arrays_zip("_l", "_w")).alias("_x")).select(group, F.col("_x._l.o").alias(order), F.col("_x._l.s").alias(size), F.col("_x._w").alias("window"))


def tiles(df: DataFrame, group: str, order: str, size: int = 5, out: str = "tile") -> DataFrame:
    """Consecutive runs of ``size`` rows, numbered from 0."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def page_windows(spans: DataFrame, group: str, start: str, length: str, size: int, step: int) -> DataFrame:
    """Sliding windows [w, w + size) every ``step`` of a text's length with the spans that begin in them; empty ones are left out.

    A span finds its windows by arithmetic: no range join.
    """
    last = F.floor(F.col(start) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(start) - size) / step) + 1)
    at = spans.where(F.col(start) < F.col(length)).select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_w"))
    return at.withColumn("window_start", F.col("_w") * step).drop("_w")


def gaps(spans: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Stretches that no earlier span reaches: (group, gap_start, gap_end) before each span that begins after all before it end."""
    w = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.lit(0))
    return spans.withColumn("gap_start", reach).where(F.col("gap_start") < F.col(start)).select(group, "gap_start", F.col(start).alias("gap_end"))


def numbers(text: Column) -> Column:
    """Numbers of a text, composites kept whole, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def unwrapped(line: Column) -> Column:
    """A line without the number that it both begins and ends with."""
    return F.regexp_replace(line, r"^\s*(\d+)([A-Z].*?)\1\s*$", "$2")


def stamps(df: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """Dates that a text holds at least twice."""
    d = df.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(STAMP), F.lit(0))).alias("stamp"))
    return d.groupBy(key, "stamp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def drifted(stated: DataFrame, source: DataFrame, group: str, value: str = "number") -> DataFrame:
    """Stated values that the source lacks but holds with exactly one character changed (two or more long): the least such value."""
    missing = stated.select(group, value).distinct().join(source.select(group, value).distinct(), [group, value], "left_anti")
    # a value meets those that agree with it but for one blanked place
    blank = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("?"), F.substring(c, i + 1, F.length(c))))
    a = missing.where(F.length(value) >= 2).select(group, F.col(value), F.explode(blank(F.col(value))).alias("_m"))
    b = source.select(group, F.col(value).alias("original")).distinct().where(F.length("original") >= 2).select(group, "original", F.explode(blank(F.col("original"))).alias("_m"))
    return a.join(b, [group, "_m"]).where(F.col(value) != F.col("original")).groupBy(group, value).agg(F.min("original").alias("original"))


def band_median(df: DataFrame, group: str, order: str, tokens: str, step: int | None = 1, reach: int = 11) -> DataFrame:
    """Upper median of the token Jaccard between rows at most ``reach`` places apart, the first at every ``step``-th place.

    Without a step it is a sixtieth of the group's rows, at least 1.
    """
    from ..functions.text import jaccard

    by = Window.partitionBy(group)
    ahead = by.orderBy(order)
    every = F.lit(step) if step else F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(by) / 60))
    # dealt out as it came, and cut into tokens there: each row is shuffled once, and meets those after it in its window
    r = df.where(F.col(group).isNotNull()).repartition(group).select(group, order, F.struct(F.array_distinct(tokens).alias("t")).alias("_t"))
    r = r.select(group, "_t", (F.row_number().over(ahead) - 1).alias("_i"), F.collect_list("_t").over(ahead.rowsBetween(1, reach)).alias("_next"), every.alias("_step"))
    near = r.where((F.col("_i") % F.col("_step") == 0) & (F.size("_next") > 0)).select(group, F.transform("_next", lambda y: jaccard(F.col("_t.t"), y.t)).alias("s"))
    return near.groupBy(group).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("_s")).select(group, F.get("_s", F.floor(F.size("_s") / 2).cast("int")).alias("median"), F.size("_s").alias("pairs"))
