import random
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing

from .conftest import prose


def filled(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 500, "b": 20, "c": 3000, None: 10}, {"a": 100}, {"a": 0, "b": 70}, {f"s{i:02}": 7**(i % 5) for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf", "x y", None, "  a  b  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_points_are_golden(spark):
    step = mixing.GOLDEN
    df = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 12345, 2**33 + 7]], "i long")
    for r in df.select("i", mixing._point(F.col("i")).alias("u")).collect():
        assert abs(r.u - (r.i * step % 2**64) / 2**64) < 1e-8


def test_takes_near_targets(spark, odd, none_at_all):
    rows = [(i, prose(20 + (i * 7) % 90, i), "big" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    by = got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.sum("size").alias("z"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.k - r.t) <= 0.01 * r.t + 3 and r.z == r.s for r in by)
    assert not got.where("taken > 3 * size OR taken < 0").count() and got.count() == 600
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none_at_all).count() == 0
    assert mixing.mix(odd.where("doc_id IN (100, 101)")).agg(F.sum("taken")).first()[0] == 0


def test_small_sources_beside_a_large_total(spark, monkeypatch):
    # the block of a 30 GB corpus
    monkeypatch.setattr(mixing, "block_words", lambda total: mixing.LARGEST_BLOCK)
    rows = [(i, prose(100, i), "small") for i in range(10)] + [(100 + i, prose(100, i), "some") for i in range(50)] + [(1000 + i, prose(20_000, i), "vast") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()}
    assert (by["small"].t, by["some"].t) == (3000, 15000)
    assert all(abs(r.k - r.t) <= 0.02 * r.t for r in by.values()), by


def test_stage(spark, odd, none_at_all):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert mixing.mixed(none_at_all).count() == 0
    words = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()
    targets = {r.source: r.target for r in mixing.mix(odd).select("source", "target").distinct().collect()}
    assert all(abs(r.w - targets[r.source]) < 0.2 * targets[r.source] + 30_000 for r in words)


def test_taken_words_equal_a_walk_through_the_schedule(spark):
    """Slots, blocks and words by plain loops over every word of a small corpus."""
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randint(0, 40)), r.choice(["a", "b", "c", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(docs).collect()}
    placed = docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()
    hashed = {x.doc_id: x.h for x in placed}
    size = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target = {x.source: x.target for x in got.values()}
    everything = sum(total.values())
    most = {s: min(mixing.block_words(everything), max(1, total[s] // mixing.CUTS)) for s in names}
    blocks = {s: -(-total[s] // most[s]) for s in names}
    share = {s: target[s] * blocks[s] / total[s] for s in names}
    slots, line, low = round(sum(share.values())), {}, 0.0
    for s in names:
        line[s] = (low, low + share[s])
        low += share[s]
    times, rank = {s: [0] * blocks[s] for s in names}, dict.fromkeys(names, 0)
    for t in range(slots):
        u = ((t * mixing.GOLDEN) % 2**64 >> 32) / 2**32
        (s,) = [s for s in names if line[s][0] / low <= u < line[s][1] / low]
        if rank[s] < mixing.REPEAT * blocks[s]:
            times[s][rank[s] % blocks[s]] += 1
        rank[s] += 1
    # the buckets of a source come before the hashes within them
    buckets = max(64, len(rows) // 256)
    for s in names:
        at = 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (hashed[i] % buckets, hashed[i], i)):
            want = sum(times[s][((at + k + 1) * blocks[s] - 1) // total[s]] for k in range(size[i]))
            assert got[i].taken == want, (s, i)
            at += size[i]
