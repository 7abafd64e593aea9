from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm.components import components
from corpusloom.llm.near_dup import Dart, cells, near_duplicates, throw, without_near_duplicates

from .conftest import prose


def multiset(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1 if w else 0, len(w) - 4)))


def classes(rows, similarity=0.8):
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            low = sum((a & b).values())
            high = sum((a | b).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (high and low / high >= similarity):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[root(i)].append(k)
    return {i: min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(rows))}


def near_copies(base, n, edits, seed):
    import random

    r, words, out = random.Random(seed), base.split(), []
    for _ in range(n):
        w = list(words)
        for i in r.sample(range(len(w)), edits):
            w[i] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_classes_equal_brute_force(spark, odd, edits):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(prose(200, 77), 40, edits, edits))]
    rows += [(2000 + i, prose(60, 5) + " " + prose(60, 3000 + i)) for i in range(30)]  # a passage in common
    want = classes(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((k, want[i]) for i, (k, _) in enumerate(rows))
    assert all(r.keep == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)


def test_signature_agreement_is_weighted_jaccard():
    a, b = prose(300, 1).split(), prose(300, 1).split()
    b[100:130] = [f"x{i}" for i in range(30)]
    k = 2000
    c, row = cells(pa.array([" ".join(a), " ".join(b)]), 5)
    s = throw(c, row, 2, k)
    x, y = multiset(" ".join(a)), multiset(" ".join(b))
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5


def test_fractional_weights():
    cell = np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.concatenate([np.full(400, 1.0), np.full(400, 0.5)])
    s = throw(np.concatenate([cell, cell]), np.repeat([0, 1], 400), 2, 2000, w)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_stage_keeps_one_of_each_group(spark, odd, none_at_all):
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = classes(rows)
    assert kept.count() == len({want[i] for i in range(len(rows))})
    assert without_near_duplicates(none_at_all).count() == 0
    assert near_duplicates(none_at_all).count() == 0


def test_blocks_cover_a_large_bucket(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(prose(150, 9), 60, 5, 4))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Dart(block=8)).collect()
    want = classes(rows)
    assert {r.doc_id: r.class_id for r in got} == {k: want[i] for i, (k, _) in enumerate(rows)}


def test_chains_whose_links_run_past_the_best_hub(spark):
    rows = []
    for i in range(60):
        middle = prose(200, 500 + i)
        # most buckets are shared with the nearer end, or with a text that is too far to link
        near, far, other = near_copies(middle, 1, 2, i), near_copies(middle, 1, 4, 100 + i), near_copies(middle, 1, 5, 200 + i)
        rows += [(10 * i + j, t) for j, t in enumerate([near[0], middle, far[0]] if i % 2 else [other[0], middle, far[0]])]
    want = classes(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: want[i] for i, (k, _) in enumerate(rows)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {500: 500, 501: 500}
