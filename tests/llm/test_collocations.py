import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations as C

from .conftest import prose


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, depth=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, depth + 1):
                f[lang].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in f.items():
        found = {w: a for w, a in c.items() if len(w) > 1 and a >= least}
        inside = lambda w, x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        kept = []
        for w, a in found.items():
            if any(len(x) > len(w) and 100 * b >= covered * a and inside(w, x) for x, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        for rank, (score, a, w, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, w.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_automaton_states_are_classes_of_end_positions():
    rnd = random.Random(1)
    for depth in (2, 3, 5):
        words = np.array(rnd.choices(range(5), k=300))
        head = np.array([i == 0 or rnd.random() < 0.1 for i in range(300)])
        made = C.Automaton(words, head, 5, depth)
        ends = defaultdict(set)
        for i in range(300):
            for n in range(1, depth + 1):
                a = i - n + 1
                if a >= 0 and not head[a + 1 : i + 1].any():
                    ends[tuple(words[a : i + 1].tolist())].add(i)
        for level, held in enumerate(made.levels):
            texts = list(zip(*(c.tolist() for c in made.text(level, np.arange(len(held.count))))))
            assert {t: n for t, n in zip(texts, held.count.tolist()) if n} == {t: len(e) for t, e in ends.items() if len(t) == level + 1}
            if level:
                shorter = list(zip(*(c.tolist() for c in made.text(level - 1, held.link))))
                assert shorter == [t[1:] for t in texts]
        classes = defaultdict(list)
        for t, e in ends.items():
            classes[frozenset(e)].append(len(t))
        got = sorted((i + 1, int(least) + 1) for i, places, short in made.states() for p, least in zip(places, short) if made.levels[i].count[p])
        assert got == sorted((max(x), min(x)) for x in classes.values())


def test_empty_automaton():
    made = C.Automaton(np.zeros(0, np.int64), np.zeros(0, bool), 0)
    assert [len(x.count) for x in made.levels] == [0, 0, 0]


def rows(seed, n):
    rnd = random.Random(seed)
    mark = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", ""]
    vocab = [f"{c}w{i % 4}" for i, c in enumerate("abcdefgHIJKé")] + ["New York City", "of the", "x\x00y", "中"]
    return [(rnd.choice(["en", "de", None]), "".join(rnd.choice(vocab) + rnd.choice(mark) for _ in range(rnd.randint(0, 80)))) for _ in range(n)]


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_against_brute_force(spark, odd, monkeypatch, size):
    monkeypatch.setattr(C, "SHARD_WORDS", size)
    monkeypatch.setattr(C.shards, "__defaults__", (size,))
    monkeypatch.setattr(C, "RANGE_BYTES", 4096)
    made = spark.createDataFrame(rows(size, 150), "lang string, text string").withColumn("rank", F.lit(1))
    docs = odd.where("n_chars < 3 OR n_chars IS NULL").unionByName(made, allowMissingColumns=True)
    assert collected(C.collocations(docs)) == brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()])


@pytest.mark.parametrize("options", [{"least": 2, "covered": 101}, {"depth": 4, "least": 3, "top": 7}, {"depth": 2, "least": 300}])
def test_options(spark, options):
    made = rows(9, 60)
    got = collected(C.collocations(spark.createDataFrame(made, "lang string, text string"), **options))
    assert got == brute(made, **options)


def test_copies_and_hot_words(spark):
    made = [("en", "the cat sat on the mat the end. " * 3)] * 400 + [("en", "the " + prose(30, i)) for i in range(50)]
    assert collected(C.collocations(spark.createDataFrame(made, "lang string, text string"))) == brute(made)


def test_empty_tables(spark, none_at_all):
    assert C.collocations(none_at_all).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("en", " .,")], "lang string, text string")).collect() == []
