"""Shared pieces of the operators: durable intermediate tables and vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1


# ---------------------------------------------------------------- durable intermediates
def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where the session names none and is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints/corpusloom"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs restart from it after a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``materialize`` for tables that only the block needs; they are deleted at its end."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(materialize(df, label))
        return made[-1]

    try:
        yield keep
    finally:
        for df in made:
            discard(df)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df``, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: keys that hold more than this share of the rows are joined by broadcast: there are fewer than its inverse
HOT_SHARE = 1 / 4096


def join_unique(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``key`` is unique and whose ``size`` says how many of the ``total`` rows have it.

    Rows of hot keys never meet in one task: their part of the table, of at most 4,096 rows, is broadcast. The others are
    joined by a shuffle.
    """
    hot = F.col(size) > total * HOT_SHARE
    some = F.broadcast(table.where(hot))
    return rows.join(some, key).unionByName(rows.join(some.select(key), key, "left_anti").join(table.where(~hot), key))


def discard(df: DataFrame) -> None:
    """Deletes the table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: list[Column], at: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``df`` with the position of each row in the whole order, from 0, as column ``at``; ``keep`` stores a table of it.

    Rows are cut into ranges of the order, with ties told apart by their place in the input, so that equal rows are
    spread as well. Each range numbers its own rows, and the driver adds up one count a range.
    """
    part, row, tie = free_names(df, "_part", "_row", "_tie")
    names = [*df.columns, part, row]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie)

    def number(source):
        done, mine = 0, TaskContext.get().partitionId()
        for batch in source:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, mine, np.int32)), pa.array(np.arange(done, done + n))], names=names)
            done += n

    stored = keep(ranged.mapInArrow(number, T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(row, T.LongType())])), "numbered")
    starts, before = [], 0
    for r in stored.groupBy(part).count().orderBy(part).collect():
        starts.append((r[0], before))
        before += r[1]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} int, {tie} long"))
    return stored.join(first, part).select(*df.columns, (F.col(row) + F.col(tie)).alias(at))


def key_residue(column: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))) % F.lit(modulus)


# ---------------------------------------------------------------- hashing of words
def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; bijective, so distinct inputs stay distinct."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 21
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        steps = np.full(size, base & MASK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = False
NOT_WORD[128:] = False


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying its text; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def word_spans(text: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; no word crosses the end of a text."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = ~separator[text]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(text))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order, by prefix sums of a polynomial modulo 2**64.

    Works through segments of bounded length, so that the extra memory does not grow with the text.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE[LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
        high = int(ends[j - 1])
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(table[text[low:high]] * _power(_BASE, high - low)[: high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * _power(_INVERSE, high - low)[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        i = j
    return splitmix(out)


def words_of(column: pa.Array, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts, in order, and where each text's words begin (n + 1 values)."""
    text, offsets = utf8_view(column)
    starts, ends = word_spans(text, offsets, separator)
    return hash_spans(text, starts, ends), np.searchsorted(starts, offsets, side="left").astype(np.int64)


def distinct_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte ranges, which ascend and don't overlap, and the distinct byte strings that the codes number."""
    inside = np.zeros(len(text) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = text[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return dictionary(data, offsets)


def dictionary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte strings that lie one after another, and the distinct ones."""
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each stands in the stream."""
    ordered = np.sort(stream, kind="stable" if stream.itemsize < 4 else None)  # counting sort, or vector instructions
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[heads], np.diff(np.append(heads, len(ordered)))


def give_back() -> None:
    """Returns memory that the allocators of arrow and C keep for later; an idle worker then holds little of an executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(source, limit: int = 1 << 21):
    """Record batches cut so that the strings of each come to about ``limit`` bytes; one long text is a batch of its own."""
    for batch in source:
        if batch.nbytes <= limit or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pc.binary_length(column).fill_null(0))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def counts_to_rows(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from where each row's items begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
