"""Importance resampling towards a target distribution, over hashed word n-grams counted by sorting.

Each text becomes a stream of 16-bit buckets, one for each run of one to three words. Streams are packed into tables with
the documents' offsets; sorted and run-length encoded they give the counts of both sides, and gathered again they give
each document the sum of its buckets' gains. Gumbel noise of the key makes the highest scores a sample without
replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_WORD, batches, distinct_spans, materialize, numbered, run_lengths, scratch, utf8_view, word_spans

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_POLYNOMIAL = 0xEDB88320
_shifts: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- crc32 of joined words
def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bit matrix (32 columns) times each x, modulo 2."""
    out = np.zeros(len(x), dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def shift_table(n: int) -> np.ndarray:
    """1,024 values: what each of the four bytes of a crc becomes by n further zero bytes."""
    if n not in _shifts:
        # one zero bit: x becomes x >> 1, and the polynomial is added if a bit falls out; squared for every power of two
        power = np.array([_POLYNOMIAL, *(1 << i for i in range(31))], dtype=np.uint32)
        whole, left = np.array([1 << i for i in range(32)], dtype=np.uint32), 8 * n
        while left:
            if left & 1:
                whole = _times(power, whole)
            power, left = _times(power, power), left >> 1
        byte = np.arange(256, dtype=np.uint32)
        if len(_shifts) > 4096:
            _shifts.clear()
        _shifts[n] = np.concatenate([_times(whole, byte << np.uint32(8 * k)) for k in range(4)])
    return _shifts[n]


def followed(crc: np.ndarray, table: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """crc32 of two strings together, from their own; ``at``: where in ``table`` the shift by the second one's length begins."""
    out = rest.copy()
    for k in range(4):
        out ^= table[at + (256 * k) + (crc >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
    return out


def bucket_stream(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and where each text's begin (n + 1 values).

    A text's features stand in the order of its words: the word, then the runs of two and of three that end with it. A
    null text has none. The extra memory is about 30 bytes a byte of text.
    """
    text, offsets = utf8_view(column)
    starts, ends = word_spans(text, offsets, NOT_WORD)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    codes, words = distinct_spans(LOWER[text], starts, ends)
    plain = words.to_pylist()
    alone = np.array([zlib.crc32(w) for w in plain], dtype=np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in plain], dtype=np.uint32)
    lengths, which = np.unique([len(w) + 1 for w in plain], return_inverse=True)
    table = np.concatenate([shift_table(int(n)) for n in lengths])
    shift = which.astype(np.int64) * 1024
    bounds = np.searchsorted(starts, offsets, side="left")
    nth = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))
    one = alone[codes]
    two = followed(one[:-1], table, shift[codes[1:]], after[codes[1:]])
    three = followed(two[:-1], table, shift[codes[2:]], after[codes[2:]])
    found = np.zeros((len(codes), 3), dtype=np.uint16)
    found[:, 0], found[1:, 1], found[2:, 2] = one % buckets, two % buckets, three % buckets
    has = np.minimum(nth + 1, 3)
    stream = found[np.arange(3) < has[:, None]]
    n = np.diff(bounds)
    return stream, np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0))])


def words_from(features: np.ndarray) -> np.ndarray:
    """The number of words of a text from that of its features."""
    return np.where(features > 1, (features + 3) // 3, features)


# ---------------------------------------------------------------- streams, counts, gains
def packed(documents: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(keys, offsets, stream): a row for each batch of texts; the stream holds 16-bit buckets, low byte first."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are written in 16 bits")
    kind = documents.schema[key].dataType

    def run(source):
        for batch in batches(source):
            stream, at = bucket_stream(batch.column(1), buckets)
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            ends = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at))
            yield pa.RecordBatch.from_arrays([keys, ends, pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["keys", "offsets", "stream"])

    return documents.select(key, text).mapInArrow(run, T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())]))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in all streams; a task sends one row for each bucket that it met."""

    def run(source):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in source:
            for stream in batch.column(0):
                values, n = run_lengths(np.frombuffer(stream.as_buffer(), "<u2"))
                total[values] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of the smoothed shares of target and source, in thousandths, floored."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gathered(stream: np.ndarray, offsets: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The sum of gains of each text's part of the stream; 0 where it is empty."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(gain[stream], offsets[:-1][some])
    return out


def noise(key, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, floored, from the key alone; a null key counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_sample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank): one row for each row of ``documents``; rank is null for rows not drawn.

    Null, empty and wordless texts have no features and weight 0. Rows with fewer than ``least_words`` words are never
    drawn. Equal scores are ordered by key, null keys first; rows equal in both, such as repeated ones, have ranks one
    after another. An empty table gives no rows, and an empty target draws by the source's rare buckets. Other columns
    are left out, whatever their names. A text is taken whole; a batch holds it with about 30 bytes a byte of it.
    """
    kind = documents.schema[key].dataType
    with scratch() as keep:
        streams = keep(packed(documents, key, text, buckets), "buckets")
        goal = packed(target.select(F.lit(0).alias("_"), F.col(target_text).alias("text")), "_", "text", buckets)
        gain = gains(bucket_counts(streams, buckets), bucket_counts(goal, buckets))

        def weigh(source):
            for batch in source:
                for keys, at, stream in zip(*batch.columns):
                    offsets = np.asarray(at.values)
                    names, n = keys.values, np.diff(offsets)
                    weight = gathered(np.frombuffer(stream.as_buffer(), "<u2"), offsets, gain)
                    drawn = np.array([noise(k, seed) for k in names.to_pylist()], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([names, pa.array(n), pa.array(weight), pa.array(weight + drawn), pa.array(words_from(n) >= least_words)], names=["doc_id", "n_features", "weight", "score", "_may"])

        fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score")), T.StructField("_may", T.BooleanType())]
        scored = keep(streams.mapInArrow(weigh, T.StructType(fields)), "scored")
        may = scored.where("_may")
        most = percent * may.count() // 100
        placed = numbered(may, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "_at", keep)
        ranked = placed.withColumn("rank", F.when(F.col("_at") < most, F.col("_at") + 1)).drop("_at", "_may")
        rest = scored.where("NOT _may").drop("_may").withColumn("rank", F.lit(None).cast("long"))
        # the result outlives the tables of the work, so it is a table itself
        return materialize(ranked.unionByName(rest), "sampled")


ORACLE = r"""
WITH t AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tb FROM range(256) r(i)),
d AS (SELECT doc_id, 0 AS side, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, 1, coalesce(text, '') FROM benchmark),
w AS (SELECT doc_id, side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
f AS (SELECT doc_id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
x AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)), lambda c, v: xor(c >> 8, tb[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, t),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
n AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
a AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c, n),
v AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN a USING (bucket) WHERE side = 0 GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score, len(w) >= 20 AS may FROM w LEFT JOIN v USING (doc_id) WHERE side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS k, count(*) FILTER (may) OVER () AS every FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= 5 * every // 100 THEN k END AS rank FROM o
"""
