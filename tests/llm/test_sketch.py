import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sketch


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1 if w else 0, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_contract_against_brute_force(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in sketch.fingerprints(docs, 256).collect()}
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(text), shingles(edited))) < 0.13
        assert abs(r.near_next - jaccard(shingles(text), shingles(following))) < 0.13
        if len(shingles(text)) < 256:
            assert r.distinct_shingles == len(shingles(text))
    assert got[3].fingerprint == got[104].fingerprint
    assert got[101].fingerprint == ""


@pytest.mark.parametrize("rows_a_group", [1, 3, 1000])
def test_next_row_in_any_cut(spark, monkeypatch, rows_a_group):
    monkeypatch.setattr(sketch, "ROWS_A_GROUP", rows_a_group)
    ids = [5, -3, 9, 2, 2, 1000, 77, None, 10**15]
    df = spark.createDataFrame([(k, f"t{k}") for k in ids], "doc_id long, text string")
    got = sorted(((r.doc_id, r.next_text) for r in sketch.with_next(df, ["text"]).collect()), key=str)
    order = [None, -3, 2, 2, 5, 9, 77, 1000, 10**15]
    want = sorted(((k, f"t{order[(i + 1) % len(order)]}") for i, k in enumerate(order)), key=str)
    assert got == want


def test_merge_and_edges(spark, none_at_all):
    text = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(text, " ".join(f"w{i}" for i in range(1000, 4000)))], "a string, b string")
    a, b, k = sketch.sketch(F.col("a")), sketch.sketch(F.col("b")), sketch.K
    r = df.select(sketch.resemblance(a, b).alias("j"), sketch.containment(a, b).alias("c"), sketch.distinct_shingles(a).alias("n"), (sketch.merge(a, a) == a).alias("same"), F.size(a).alias("k")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.c - 2 / 3) < 0.2 and abs(r.n / 2996 - 1) < 0.3 and r.same and r.k == k
    assert sketch.fingerprints(none_at_all).count() == 0
    one = sketch.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert one.near_next == one.near_edited == 1.0 and one.n_chars == 0
