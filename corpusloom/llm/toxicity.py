"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs that skip one word; a word is a run of ASCII
letters, digits or bytes above 127, in lower case. Per-coordinate rates and an L1 term leave few weights, which is the
broadcastable model. Only ``text`` is read: labels, language, source and key never enter a score.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, batches, counts_to_rows, give_back, key_residue, splitmix, words_of


@dataclass(frozen=True)
class Ftrl:
    """bits: the feature space has 2**bits cells, which bounds the model. rows: bound of the labelled keys that it learns from.

    bytes: bound of the examples that the learning task holds, four a cell. min_texts: a cell of fewer distinct texts of
    the sample gets no weight.
    """

    bits: int = 20
    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 6
    rows: int = 16384
    bytes: int = 1 << 28
    min_texts: int = 5


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each n-gram and skip-gram, and its text's number; unsorted, with repeats."""
    h, bounds = words_of(column, NOT_WORD)
    row = counts_to_rows(bounds)
    cells, rows = [h], [row]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt)
            cells.append(splitmix(pair[same]))
            rows.append(row[gap:][same])
    return np.concatenate(cells) >> np.uint64(64 - bits), np.concatenate(rows)


def distinct_per_row(cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.uint64) << np.uint64(32)) | cells)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Nonzero cells, their weights and the intercept. Repeated texts teach once; the intercept is learned without L1."""
    examples = list({(hashlib.blake2b(cells, digest_size=16).digest(), len(cells)): (cells, y) for cells, y in examples}.values())
    texts = np.zeros(1 << p.bits, dtype=np.int32)
    for cells, _ in examples:
        texts[cells] += 1
    examples = [(cells[texts[cells] >= p.min_texts], y) for cells, y in examples]
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    z0 = n0 = 0.0
    if examples:
        share = min(max(np.mean([y for _, y in examples]), 0.01), 0.99)
        start = float(np.log(share / (1 - share)))
    else:
        start = -2.0
    bias = start
    for _ in range(p.epochs):
        for cells, y in examples:
            zc, root = z[cells], np.sqrt(n[cells])
            w = np.where(np.abs(zc) > p.l1, -(zc - np.sign(zc) * p.l1) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            bias = start - z0 / ((p.beta + np.sqrt(n0)) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            rise = (np.sqrt(n[cells] + g * g) - root) / p.alpha
            z[cells] += g - rise * w
            n[cells] += g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / p.alpha * (bias - start)
            n0 += g * g
    kept = np.flatnonzero(np.abs(z) > p.l1)
    weights = -(z[kept] - np.sign(z[kept]) * p.l1) / ((p.beta + np.sqrt(n[kept])) / p.alpha + p.l2)
    return kept, weights, float(bias)


def train(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), holdout: int | None = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from the texts of at most ``p.rows`` labelled keys, those with the lowest hashes, in one bounded task.

    However often a key or a text is repeated, each distinct text comes to the task once, by its lowest hash and with the
    label of its highest. Texts are taken in that order as long as they fit in ``p.bytes``.
    A key labelled more than once counts as toxic if any of its labels says so; null labels are left out. Keys whose
    crc32 modulo 3 is ``holdout`` are never read.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if holdout is not None:
        marked = marked.where(key_residue("doc_id", 3) != holdout)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    sample = marked.select("doc_id", "_y", F.xxhash64("doc_id").alias("_k")).orderBy("_k", "doc_id").limit(p.rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("_k", "_y", "text")

    def prepare(source):
        for batch in batches(source):
            cells, row = distinct_per_row(*features(batch.column("text"), p.bits))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [cells[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), pa.array(packed, pa.binary())], names=["_k", "_y", "cells"])

    def learn(source):
        have, room = [], p.bytes
        for batch in source:
            # views of the batch, not copies
            for y, c in zip(batch.column("_y").to_pylist(), batch.column("cells")):
                view = np.frombuffer(c.as_buffer(), np.uint32)
                room -= view.nbytes
                if room >= 0:
                    have.append((view, y))
        cells, weights, bias = fit(have, p)
        have.clear()
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array([cells.astype(np.uint32).tobytes()]), pa.array([weights.astype(np.float64).tobytes()]), pa.array([bias])], names=["cells", "weights", "bias"]
        )

    once = rows.mapInArrow(prepare, "_k long, _y int, cells binary").groupBy("cells").agg(F.min("_k").alias("_k"), F.max_by("_y", "_k").alias("_y"))
    learned = once.repartition(1).sortWithinPartitions("_k", "cells").mapInArrow(learn, "cells binary, weights binary, bias double").collect()
    if not learned:
        return fit([], p)
    return np.frombuffer(learned[0][0], np.uint32).astype(np.int64), np.frombuffer(learned[0][1], np.float64), learned[0][2]


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: Ftrl = Ftrl(), out: str = "score") -> DataFrame:
    """``documents`` with a probability per whole text; a null text counts as empty and gets the intercept's."""
    cells, weights, bias = model
    names = [c for c in documents.columns if c != out]
    shared = documents.sparkSession.sparkContext.broadcast((cells.astype(np.int64), weights))

    def run(source):
        table = np.zeros(1 << p.bits)
        at, w = shared.value
        table[at] = w
        for batch in batches(source):
            c, row = features(batch.column("text"), p.bits)
            c = c.astype(np.int64)
            hit = table[c] != 0
            c, row = distinct_per_row(c[hit].astype(np.uint64), row[hit])
            total = np.bincount(row, weights=table[c], minlength=batch.num_rows) + bias
            s = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s)], names=[*names, out])

    from pyspark.sql import types as T

    kept = documents.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.7) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted. Repeated rows get equal scores; an empty table gives none."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels, p), p)
    return scored.select(
        "doc_id",
        (key_residue("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
