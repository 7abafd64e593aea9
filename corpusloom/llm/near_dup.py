"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its shingles of five lower-cased words, weighted by how often they occur (a text of one to
four words is one shingle). Each unit of weight of a shingle is a cell; hashed darts fall into a cell as a Poisson
process along the rank axis, each with a coordinate of the signature, and a coordinate keeps its earliest dart. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity. A text throws about
k (ln k + 2) darts whatever its length, and more only while a coordinate is empty.

Signatures are joined by bands. Within a bucket every text is compared with the least one (a star), components are
formed, and only buckets that still hold several components are compared further, in blocks of bounded size: pairs in
one component need no check, since they cannot change it. Every other pair whose signatures come near the threshold is
checked on whole shingle sets, within its group, so that no table of pairs is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, counts_to_rows, free_names, join_unique, materialize, scratch, splitmix, words_of
from .components import components


@dataclass(frozen=True)
class Dart:
    """bands x rows coordinates. At similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**30 = 1.1e-4."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 6
    block: int = 256

    @property
    def k(self) -> int:
        return self.bands * self.rows


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every shingle, in order, with repeats."""
    h, bounds = words_of(column)
    row = counts_to_rows(bounds)
    sizes = np.diff(bounds)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(words):
        rolled[: len(h) - j] += splitmix(h[j:] + np.uint64(j + 1))
    starts_ok = np.arange(len(h)) + words <= bounds[1:][row]
    out, out_row = [splitmix(rolled[starts_ok])], [row[starts_ok]]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        made = [np.bitwise_xor.reduce(splitmix(h[bounds[r] : bounds[r + 1]] + np.arange(101, 101 + sizes[r], dtype=np.uint64))) for r in short]
        out.append(np.array(made, np.uint64))
        out_row.append(short)
    return np.concatenate(out), np.concatenate(out_row)


def cells(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells (shingle, number of the occurrence) and their rows; the weighted Jaccard is the plain one of cells."""
    s, row = shingles(column, words)
    if not len(s):
        return s, row
    key = splitmix(s + splitmix(row.astype(np.uint64)))
    order = np.argsort(key)
    key, s, row = key[order], s[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(at, np.diff([*at, len(key)]))
    return splitmix(s + splitmix(nth.astype(np.uint64) + np.uint64(7))), row


def throw(cell: np.ndarray, row: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """n x k signatures; a row without cells stays at the largest value. ``weight`` in (0, 1] is the filled part of a cell."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, empty, np.uint64)
    load = np.bincount(row, weights=weight, minlength=n)
    level = np.where(load > 0, k * (np.log(k) + 2) / np.maximum(load, 1e-9), 0.0)
    rank, state = np.zeros(len(cell)), cell.copy()
    waiting = np.arange(len(cell))

    def advance(which):
        state[which] = splitmix(state[which] + np.uint64(0x9E3779B97F4A7C15))
        rank[which] -= np.log(((state[which] >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)

    advance(waiting)
    while True:
        live = waiting[rank[waiting] < level[row[waiting]]]
        while len(live):
            dart = splitmix(state[live] ^ np.uint64(0x5851F42D4C957F2D))
            hit, r, d = rank[live], row[live], dart
            if weight is not None:
                inside = (splitmix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < weight[live]
                hit, r, d = hit[inside], r[inside], d[inside]
            value = (hit.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (d & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, r * k + (d >> np.uint64(32)).astype(np.int64) % k, value)
            advance(live)
            live = live[rank[live] < level[row[live]]]
        gaps = (best.reshape(n, k) == empty).any(axis=1) & (load > 0)
        if not gaps.any():
            return best.reshape(n, k)
        level[gaps] *= 1.5
        waiting = np.flatnonzero(gaps[row])


def band_keys(signature: np.ndarray, p: Dart) -> np.ndarray:
    n = len(signature)
    parts = splitmix(signature.reshape(n, p.bands, p.rows) + np.arange(1, p.rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return splitmix(parts.sum(axis=2, dtype=np.uint64) + np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def identity(text: str = "text") -> Column:
    """128 bits that stand for a text, null as empty: equal texts are one node, and different ones don't meet in 10**15 texts."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sign(documents: DataFrame, p: Dart) -> DataFrame:
    """(doc_id, node, keys, signature) of each row; node is the text's identity."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), identity().alias("node"))

    def run(source):
        for batch in batches(source):
            n = batch.num_rows
            c, row = cells(batch.column("text"), p.words)
            s = throw(c, row, n, p.k)
            have = np.bincount(row, minlength=n) > 0
            keys = band_keys(s, p).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(have, p.bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[have].ravel()))
            short = np.ascontiguousarray((s & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "node", "keys", "signature"]
            )

    kind = rows.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(fields))


def _membership(nodes: DataFrame) -> np.ndarray:
    """Bits by the low part of each node's hash: at most 2**27 of them (16 MB), sixteen a node while that suffices."""
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, nodes.count()))), 10, 27))
    low = nodes.select(F.xxhash64("node").bitwiseAND(F.lit(size - 1)).alias("at"))
    words = low.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[np.asarray(words.column("w").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).view(np.uint64)
    return table


def cell_sets(documents: DataFrame, nodes: DataFrame, p: Dart) -> DataFrame:
    """(node, cells): the sorted cell hashes, as bytes, of one text of each node asked for.

    Texts are not shuffled: a broadcast bit table leaves out most that nobody asked for, and an exact join the rest.
    """
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"), identity().alias("node")).withColumn("low", F.xxhash64("node"))
    asked = documents.sparkSession.sparkContext.broadcast(_membership(nodes))

    def run(source):
        bits, seen = asked.value, set()
        cut = np.uint64(len(bits) * 64 - 1)
        for batch in batches(source):
            low = np.asarray(batch.column("low")).view(np.uint64) & cut
            want = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
            some = batch.column("node").take(pa.array(np.flatnonzero(want))).to_pylist()
            take, node = [], []
            for i, k in zip(np.flatnonzero(want), some):
                # copies within one partition are sent once, as far as the memory of the latest nodes goes
                if k not in seen:
                    if len(seen) >= 1 << 17:
                        seen.clear()
                    seen.add(k)
                    take.append(i)
                    node.append(k)
            if not take:
                continue
            c, row = cells(batch.column("text").take(pa.array(take)), p.words)
            order = np.lexsort((c, row))
            c = c[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(take)))])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["node", "cells"])

    found = texts.select("node", "low", "text").mapInArrow(run, "node binary, cells binary")
    return found.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole cell sets reach ``similarity``, with it."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("cells").alias("_ca")), "a").join(sets.select(F.col("node").alias("b"), F.col("cells").alias("_cb")), "b")

    def run(source):
        for batch in source:
            kept = []
            for x, y in zip(batch.column("_ca"), batch.column("_cb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = min(len(x), len(y)), max(len(x), len(y))
                if most == 0 or least < similarity * most:
                    kept.append(1.0 if most == 0 else 0.0)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                kept.append(common / (len(x) + len(y) - common))
            s = np.array(kept)
            take = pa.array(np.flatnonzero(s >= similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(s[s >= similarity])], names=["a", "b", "similarity"])

    return joined.select("a", "b", "_ca", "_cb").mapInArrow(run, "a binary, b binary, similarity double")


def _shared(signed: DataFrame) -> DataFrame:
    """Distinct (key, node, hub) of the buckets that hold more than one text; hub is the bucket's least node."""
    bands = signed.select("node", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_m")).where("hub <> _m").select("key", "hub")
    return bands.join(hubs, "key").select("key", "node", "hub").distinct()


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each text with the one hub that it shares most buckets with, the least of equals."""
    met = shared.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("hub").alias("h"))).alias("m"))
    return best.select(F.col("node").alias("a"), F.col("m.h").alias("b"))


def _across(shared: DataFrame, labels: DataFrame, stars: DataFrame, signed: DataFrame, p: Dart, keep=materialize) -> DataFrame:
    """(key, x, y, node, label, partners): texts of buckets that hold several components, with the texts to compare them with.

    A bucket of m texts is cut into ceil(m / block) blocks, and each pair of blocks is one bounded group. Partners are of
    another component and agree in signature within five standard deviations of the threshold. A pair belongs to the
    first bucket that both texts share and to the text whose component has fewer texts in the group; the other text is
    a row too. Rows are at most the texts of each group, however many pairs they make. A bucket of two texts is left out
    only where they are a pair of ``stars``, which is checked already.
    """
    known = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    known = keep(known, "bucket-labels")
    split = known.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.max("node").alias("_a"), F.min("node").alias("_b")).where("_lo <> _hi")
    # a hub is the least of its bucket, so the star pair of a bucket of two runs from its greater text to its lesser
    split = split.join(stars, (F.col("_m") == 2) & (F.col("_a") == stars["a"]) & (F.col("_b") == stars["b"]), "left_anti").select("key", "_m")
    open_rows = known.join(split, "key").withColumn("_blocks", F.ceil(F.col("_m") / p.block).cast("int")).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    signatures = signed.select("node", "keys", "signature").join(open_rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    placed = open_rows.join(signatures, "node").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select("key", F.least("_i", "_j").alias("x"), F.greatest("_i", "_j").alias("y"), "_i", "node", "label", "keys", "signature")
    floor = p.similarity - 5 * (p.similarity * (1 - p.similarity) / p.k) ** 0.5

    def run(group, table):
        key, x, y = (v.as_py() for v in group)
        names, side = table.column("node").to_pylist(), np.asarray(table.column("_i"))
        labels = table.column("label").to_pylist()
        # places in order stand for the identities themselves
        place = {k: i for i, k in enumerate(sorted({*names, *labels}))}
        node, label = np.array([place[k] for k in names]), np.array([place[k] for k in labels])
        s = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(node), p.k)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        _, kind, count = np.unique(label, return_inverse=True, return_counts=True)
        size = count[kind]
        partners, needed = [[] for _ in node], np.zeros(len(node), bool)
        for i in range(len(node)):
            asks = (label != label[i]) & ((size > size[i]) | ((size == size[i]) & (node < node[i])))
            if x != y:
                asks &= side != side[i]
            other = np.flatnonzero(asks)
            if not len(other):
                continue
            alike = (s[other] == s[i]).mean(axis=1)
            other, alike = other[alike >= floor], alike[alike >= floor]
            first = keys[i][(keys[other] == keys[i]).argmax(axis=1)] == key
            other = other[first][np.lexsort((node[other[first]], -alike[first]))]
            if len(other):
                partners[i] = [names[o] for o in other]
                needed[i] = needed[other] = True
        at = np.flatnonzero(needed)
        n = len(at)
        return pa.table(
            {
                "key": pa.array([key] * n, pa.int64()), "x": pa.array([x] * n, pa.int32()), "y": pa.array([y] * n, pa.int32()),
                "node": pa.array([names[i] for i in at], pa.binary()), "label": pa.array([labels[i] for i in at], pa.binary()), "partners": pa.array([partners[i] for i in at], pa.list_(pa.binary())),
            }
        )

    return placed.groupBy("key", "x", "y").applyInArrow(run, "key long, x int, y int, node binary, label binary, partners array<binary>")


def _links_across(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): pairs of ``asked`` that link, checked on whole cell sets within their group.

    A pair whose components a link of the group has joined already is left out: it can't change a component.
    """

    def run(group, table):
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        cell = {k: np.frombuffer(c, np.uint64) for k, c in zip(node, table.column("cells").to_pylist())}
        home, parent = dict(zip(node, label)), {}

        def root(v):
            while parent.get(v, v) != v:
                parent[v] = v = parent.get(parent[v], parent[v])
            return v

        out = []
        for k, others in zip(node, table.column("partners").to_pylist()):
            for o in others:
                u, v = root(home[k]), root(home[o])
                a, b = cell[k], cell[o]
                if u == v or min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                j = common / (len(a) + len(b) - common)
                if j >= similarity:
                    parent[u] = v
                    out.append((k, o, j))
        a, b, j = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(j, pa.float64())})

    joined = asked.join(sets, "node").select("key", "x", "y", "node", "label", "partners", "cells")
    return joined.groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary, similarity double")


def near_duplicates(documents: DataFrame, p: Dart = Dart()) -> DataFrame:
    """(doc_id, class_id, copies, keep, text_hash, group_hash) for every row of ``documents``.

    class_id is the least doc_id of the group of texts connected by similarities of ``p.similarity`` or more; equal
    texts are always together, null and empty texts in one group. copies counts the rows of the group, keep marks its
    least doc_id (all rows that repeat that doc_id). A null doc_id is a row of its group and kept only if the whole
    group has no other. An empty table gives an empty result.
    """
    with scratch() as keep:
        signed = keep(sign(documents, p), "signed")
        shared = keep(_shared(signed), "shared")
        pairs = keep(_stars(shared), "stars")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        links = keep(verify(pairs, cell_sets(documents, nodes, p), p.similarity), "links")
        labels = keep(components(links), "components")
        asked = keep(_across(shared, labels, pairs, signed, p, keep), "asked")
        if asked.limit(1).count():
            more = keep(_links_across(asked, cell_sets(documents, asked.select("node").distinct(), p), p.similarity), "links")
            labels = keep(components(links.unionByName(more)), "components")
        # one row a text before anything is joined; what a text or group repeats is counted on the way to the shuffle
        texts = signed.groupBy("node").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
        texts = keep(texts.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("group_hash"), "_least", "_rows"), "texts")
        groups = texts.groupBy("group_hash").agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("copies"), F.count(F.lit(1)).alias("_texts"))
        of_text = keep(join_unique(texts, groups, "group_hash", "_texts", texts.count()).select("node", "group_hash", "class_id", "copies", "_rows"), "groups")
        found = join_unique(signed.select("doc_id", "node"), of_text, "node", "_rows", signed.count())
        return materialize(
            found.select("doc_id", "class_id", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"), F.hex("node").alias("text_hash"), F.hex("group_hash").alias("group_hash")), "near-duplicates"
        )


MOST_BROADCAST = 1_000_000


def without_near_duplicates(documents: DataFrame, p: Dart = Dart()) -> DataFrame:
    """``documents`` with one row of each group: the least doc_id, and one of the rows that repeat it with one text.

    Rows to drop are told by key and text. They are broadcast up to MOST_BROADCAST keys (128 MB); beyond, both sides are
    shuffled.
    """
    marked = near_duplicates(documents, p)
    node, d, h = free_names(documents, "_node", "_d", "_h")
    hashed = documents.withColumn(node, F.hex(identity()))
    drop = materialize(marked.where("NOT keep").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "dropped")
    small = drop.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    same = hashed["doc_id"].eqNullSafe(drop[d]) & (hashed[node] == drop[h])
    kept = hashed.join(F.broadcast(drop) if small else drop, same, "left_anti")
    # groups whose least key comes in several rows keep of them the first text by hash, once
    several = marked.where("keep").groupBy("group_hash", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias(h)).where("n > 1")
    several = materialize(several.select("group_hash", F.col("doc_id").alias(d), h), "repeated")
    if not several.limit(1).count():
        return kept.select(*documents.columns)
    repeated = marked.where("keep").join(several.select("group_hash"), "group_hash", "left_semi").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    is_in = lambda t: kept["doc_id"].eqNullSafe(t[d]) & (kept[node] == t[h])
    alone = kept.join(repeated, is_in(repeated), "left_anti")
    first = kept.join(several, is_in(several), "left_semi").dropDuplicates(["doc_id", node])
    return alone.unionByName(first).select(*documents.columns)
