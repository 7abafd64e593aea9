"""What queries shuffle grows with their input, not with pairs of rows or with tokens by the scopes they are asked in."""

import hashlib
import json
import random
import time
import tracemalloc
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import entities, graph, overlap, scenes
from corpusloom.plans import parsing
from corpusloom.plans.unit_catalog import QUERIES


def shuffled(spark, df):
    """Bytes that computing ``df`` writes to shuffles, and its rows."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)  # the store of figures is refreshed by time
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    rows = df.collect()
    return written() - before, rows


def texts(n, words=60, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    return [" ".join(rnd.choices(vocabulary, k=words)) for _ in range(n)]


@pytest.fixture(scope="module")
def copied(spark):
    sources = texts(400)
    within = "array<struct<scope:int,place:string>>"
    rows = [(f"f{i}", [(0, f"p{i}"), (1, "all" if i < 9 else f"d{i // 8}")], " ".join(t.split()[i % 7 : i % 7 + 5 + i % 30]) + " end") for i, t in enumerate(sources)]
    # a place of many sources, one of several fields, and the same text twice
    held = [(0, f"p{i}", t) for i, t in enumerate(sources)] + [(1, "all" if i < 9 else f"d{i // 8}", t) for i, t in enumerate(sources)] + [(0, "p0", sources[0])]
    fields = spark.createDataFrame(rows, f"field string, within {within}, text string").cache()
    return fields, spark.createDataFrame(held, "scope int, place string, text string").cache(), rows, held


def test_longest_matches_equal_plain_python_in_rows_and_by_grams(spark, copied):
    fields, sources, rows, held = copied
    runs = {}
    for scope, place, text in held:
        t = text.split()
        runs.setdefault((scope, place), set()).update(tuple(t[i : i + k]) for k in range(6, 26) for i in range(len(t) - k + 1))
    want = set()
    for field, within, text in rows:
        t = text.split()
        found = [(k, -p, -s) for s, place in within for k in range(6, 26) for p in range(len(t) - k + 1) if tuple(t[p : p + k]) in runs.get((s, place), ())]
        if found:
            k, p, s = max(found)
            want.add((field, k, -p, -s, " ".join(t[-p : -p + k])))
    assert len(want) > 300
    for row in (overlap.ROW, 900, 0):  # all in rows, some by grams, all by grams
        got = overlap.longest_matches(fields, sources, row=row).collect()
        assert {(r.field, r.run, r.start, r.scope, " ".join(r.gram)) for r in got} == want and len(got) == len(want)


def test_longest_matches_shuffle_texts_only(spark, copied):
    fields, sources, rows, held = copied
    size = sum(len(r[2]) * 2 for r in rows) + sum(len(r[2]) for r in held)
    # joined by grams, each token goes through several shuffles with its place: ten times as much
    assert shuffled(spark, overlap.longest_matches(fields, sources))[0] < 2 * size


OBJECT = "window int, ao_id string, scene_id string, grounded_in array<string>, type string, confidence string"


def test_draft_errors_by_window_and_in_every_window(spark):
    rows = [(1, "a", "s1", ["s1#1", None], "motive", "plausible"), (1, "b", "s1", ["s1#1", "s1#1"], "motive", "plausible"), (2, "c", "s1", ["s1#1"], "motive", "plausible"), (None, "d", "s1", ["s1#1"], "motive", "plausible"), (1, "e", "s2", None, "motive", "plausible")]
    objects = spark.createDataFrame(rows, OBJECT)
    of = lambda scenes, beats: {(r.ao_id, r.error) for r in graph.draft_errors(objects, scenes, beats, ("motive",)).collect()}
    outside, unknown = "scene outside the window", "unknown grounds"
    windowed = of(spark.createDataFrame([(1, "s1")], "window int, scene_id string"), spark.createDataFrame([(1, "s1#1"), (1, "s1#1")], "window int, ref string"))
    assert windowed == {("a", unknown), ("c", outside), ("c", unknown), ("d", outside), ("d", unknown), ("e", outside), ("e", "no grounds")}
    everywhere = of(spark.createDataFrame([("s1",)], "scene_id string"), spark.createDataFrame([("s1#1",)], "ref string"))
    assert everywhere == {("a", unknown), ("e", outside), ("e", "no grounds")}


def test_draft_errors_of_all_windows_grow_with_the_rows(spark, tmp_path):
    def tables(n):
        at = str(tmp_path / str(n))
        spark.range(n).selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{at}/documents.parquet")
        spark.range(n).selectExpr("id div 3 AS conv_id", "id % 3 AS turn", "'user' AS role", "'t' AS text").write.parquet(f"{at}/conversations.parquet")
        return at

    few, many = (shuffled(spark, QUERIES["draft_errors"](spark, tables(n)))[0] for n in (1000, 8000))
    # each window had a copy of every scene and beat before: 60 times as much
    assert many < 12 * few


def names(n):
    rnd = random.Random(9)
    alike = [(1, f"Supplier#{i:09d}") for i in range(n)]
    mixed = [(2, " ".join(rnd.choices(["red", "blue", "gear", "ring", "bolt", "of", "x1", "long handled", "Ring"], k=rnd.randint(1, 4)))) for _ in range(n)]
    return alike + mixed + [(1, "x"), (1, "X!"), (1, None), (None, "Supplier#000000001"), (1, "")]


def test_pairs_equal_all_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 16)  # so that frequent keys stand in parts
    rows = sorted(set(names(60)), key=str)
    df = spark.createDataFrame(rows + rows[:20], "doc_id int, name string")
    key = {r.name: r.k for r in df.select("name", X.spaced_key(F.col("name")).alias("k")).collect()}
    words = {x: set(k.split()) for x, k in key.items()}
    met = [(g, a, b) for g, a in rows for h, b in rows if g is not None and g == h and a is not None and b is not None and a < b]
    share = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) if min(len(words[a]), len(words[b])) >= 2 else -1
    for least in (0.3, 0.5, 0.8):
        got = [tuple(r) for r in entities.token_pairs(df, "doc_id", least=least).collect()]
        assert sorted(got) == sorted((g, a, b, share(a, b)) for g, a, b in met if share(a, b) >= least)
    got = [tuple(r) for r in entities.alias_pairs(df, "doc_id").collect()]
    assert sorted(got) == sorted(p for p in met if share(*p[1:]) >= 0.5 or SequenceMatcher(None, key[p[1]], key[p[2]]).ratio() >= 0.72)


def test_pairs_are_not_shuffled(spark):
    frames = [spark.createDataFrame([r for r in names(n) if r[0] == 1 and r[1]], "doc_id int, name string") for n in (200, 800)]
    few, many = (shuffled(spark, entities.alias_pairs(df, "doc_id")) for df in frames)
    assert len(many[1]) >= 800 * 799 / 2 and many[0] < 6 * few[0]


def test_pairs_of_a_frequent_word_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 50, raising=False)
    df = spark.createDataFrame([r for r in names(400) if r[0] == 1 and r[1]], "doc_id int, name string")
    made = entities.token_pairs(df, "doc_id", least=0.3).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 400 * 399 / 2 and len(made) > 1


@pytest.mark.parametrize("step", [1, None])
def test_band_median_equals_plain_python_and_shuffles_rows_once(spark, step):
    said = texts(600, 40, 5)
    rows = [(None if i % 50 == 0 else i % 3 if i % 7 else i, i, " ".join(t.split()[: i % 40] + said[i - 1].split()[:9])) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "g int, o int, text string").repartition(4).cache()
    df.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more rows
    try:
        size, got = shuffled(spark, scenes.band_median(df, "g", "o", F.split("text", " "), step=step))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups, want = {}, set()
    for g, _, t in rows:
        groups.setdefault(g, []).append(set(t.split(" ")))
    for g, sets in groups.items():
        each = step or max(1, len(sets) // 60)
        s = sorted(len(a & b) / len(a | b) for i, a in enumerate(sets) if i % each == 0 for b in sets[i + 1 : i + 12])
        if s and g is not None:
            want.add((g, s[len(s) // 2], len(s)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    if step:
        # each row went along with eleven others before
        assert size < 2 * sum(len(r[2]) for r in rows)


def test_minhash_keeps_a_bounded_number_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(overlap, "KEPT", 1 << 10, raising=False)
    said = [None, "", "A a " + " ".join(f"Long{j}" for j in range(3000)), *(" ".join(f"t{i}x{j}" for j in range(100)) for i in range(1500)), "A a"]
    tracemalloc.start()
    got = overlap.token_minhash(4).func(pa.array(said, pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()

    def want(text):
        tokens = {t.encode() for t in (text or "").lower().split()}
        return [min(int.from_bytes(hashlib.blake2b(i.to_bytes(4, "little") + t, digest_size=8).digest(), "little") for t in tokens) for i in range(4)] if tokens else []

    assert [list(map(int, x)) for x in got.to_pylist()] == [want(t) for t in said]
    assert peak < 4_000_000  # the 150,000 tokens and their digests take over 20 MB


def test_units_are_parsed_a_few_at_a_time(spark):
    answer = json.dumps({"context_summary": "s", "entities": [{"name": f"n{i}", "type": "person"} for i in range(50)]})
    texts = pa.array([answer] * 2000 + ["broken", None])
    tracemalloc.start()
    got = parsing.parsed.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2002 and got[1999].as_py()["entities"][49]["name"] == "n49" and got[2000].as_py()["error"] and got[2000].as_py()["entities"] == []
    assert peak < 12_000_000  # 100,000 entities as Python objects take over 60 MB


def test_pairs_settled_by_bags_never_come_to_python(spark, monkeypatch):
    @F.pandas_udf("double")
    def never(a: pd.Series, b: pd.Series) -> pd.Series:
        raise AssertionError("asked")

    monkeypatch.setattr(entities, "BLOCK", 100)  # so that some blocks meet others
    monkeypatch.setattr(entities, "spelling_ratio", never)
    rows = [(g, f"Supplier#{i:09d}") for g in (1, 2) for i in range(1000 + g, 1000000, 6661)]
    df = spark.createDataFrame(rows, "doc_id int, name string")
    got = [tuple(r) for r in entities.alias_pairs(df, "doc_id").collect()]
    alike = lambda a, b: SequenceMatcher(None, a.lower().replace("#", " "), b.lower().replace("#", " ")).ratio() >= 0.72
    assert sorted(got) == sorted((g, a, b) for g, a in rows for h, b in rows if g == h and a < b and alike(a, b))
    # twelve letters stand at the start of all, and thirteen are needed: neither all pairs nor only those of one more
    assert len(got) < 150 * 149
    assert len(got) > sum(a[:13] == b[:13] for g, a in rows for h, b in rows if g == h and a < b)
