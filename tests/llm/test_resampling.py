import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import resampling as R

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(rows, goal):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, goal)):
        for text in texts:
            for b in features(text)[0]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out, may = [], []
    for i, (key, text) in enumerate(rows):
        f, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, None])
        if n >= 20:
            may.append((-score, key is not None, key, i))
    may.sort(key=lambda r: (r[0], r[1], r[2] or 0))
    for rank, r in enumerate(may[: 5 * len(may) // 100], 1):
        out[r[3]][4] = rank
    return out


def test_crc_of_joined_words():
    for n in (1, 2, 7, 8, 300, 70_000):
        b = bytes(i * 7 % 256 for i in range(n))
        a = zlib.crc32(b"some words")
        got = R.followed(np.array([a], np.uint32), R.shift_table(n), np.zeros(1, np.int64), np.array([zlib.crc32(b)], np.uint32))
        assert int(got[0]) == zlib.crc32(b"some words" + b)


def test_streams_hold_all_features():
    texts = ["One two THREE four", None, "", "x", "é𝛼 Öl\x00b\x7fc 12-34", "two words", "... !", "w" * 5000 + " end", "a b c"]
    stream, at = R.bucket_stream(pa.array(texts))
    for i, text in enumerate(texts):
        want, n = features(text)
        assert sorted(stream[at[i] : at[i + 1]].tolist()) == sorted(want)
        assert R.words_from(np.diff(at))[i] == n


def test_run_lengths():
    values, n = R.run_lengths(np.array([5, 1, 5, 65535, 1, 5], np.uint16))
    assert values.tolist() == [1, 5, 65535] and n.tolist() == [2, 3, 1]
    assert len(R.run_lengths(np.zeros(0, np.uint16))[0]) == 0


def test_against_brute_force(spark, odd):
    goal = spark.createDataFrame([(1, "alpha beta gamma " * 9), (2, None), (3, "omicron pi rho sigma tau")], "item_id long, text string")
    more = spark.createDataFrame([(1000 + i, prose(10 + i % 40, i)) for i in range(300)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", F.lit(7).alias("score"), F.lit("x").alias("_at")).unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [r.text for r in goal.collect()])
    got = [[*r] for r in R.importance_sample(docs, goal).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], r[4] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in got) >= 10


@pytest.mark.parametrize("percent", [50, 100])
def test_repeated_rows_and_ties_have_ranks_of_their_own(spark, percent):
    docs = spark.createDataFrame([(7, prose(30, 1))] * 500 + [(8, prose(30, 1))] * 3, "doc_id long, text string")
    got = R.importance_sample(docs, docs, percent=percent).collect()
    ranks = sorted(r.rank for r in got if r.rank)
    assert len(got) == 503 and ranks == list(range(1, 503 * percent // 100 + 1))
    by_rank = sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank)
    assert [r[1:] for r in by_rank] == sorted(r[1:] for r in by_rank)


def test_empty_tables(spark, none_at_all):
    some = spark.createDataFrame([(1, prose(25, 1)), (2, None)], "doc_id long, text string")
    assert R.importance_sample(none_at_all, some).collect() == []
    got = R.importance_sample(some, none_at_all, percent=100).collect()
    assert {(r.doc_id, r.rank) for r in got} == {(1, 1), (2, None)}
    with pytest.raises(ValueError):
        R.packed(some, buckets=70_000)
