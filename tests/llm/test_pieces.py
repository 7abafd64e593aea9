import math
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import pieces


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.DEFAULT_MODEL)


def every(v, text):
    """All segmentations of a text and their weights, by plain recursion."""
    shown = "▁" + text.replace(" ", "▁")
    table = {v.bytes_of[i].decode("utf-8", "replace").replace(" ", "▁"): (i, float(v.logp[n])) for n, i in enumerate(v.ids)}

    def walk(at):
        if at == len(shown):
            yield (), 0.0
        for end in range(at + 1, min(len(shown), at + v.longest) + 1):
            if shown[at:end] in table:
                i, w = table[shown[at:end]]
                for rest, x in walk(end):
                    yield (i, *rest), w + x

    paths = dict(walk(0))
    total = math.log(sum(math.exp(x) for x in paths.values()))
    return {k: x - total for k, x in paths.items()}


@pytest.mark.parametrize("text", ["that", "a b", "here"])
def test_samples_follow_gumbel_top_k(v, text):
    exact = every(v, text)
    n = 4000
    got = pieces.sample([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(13) + np.uint64(1), v, 2)
    for row in got:
        assert len({tuple(ids.tolist()) for ids, _, _ in row}) == len(row) == 2
        for ids, logp, inclusion in row:
            assert abs(logp - exact[tuple(ids.tolist())]) < 1e-3 and 0 < inclusion <= 1
    first, second = Counter(tuple(r[0][0].tolist()) for r in got), Counter(tuple(r[1][0].tolist()) for r in got)
    p = {k: math.exp(x) for k, x in exact.items()}
    for k in sorted(p, key=p.get, reverse=True)[:4]:
        later = sum(p[j] * p[k] / sum(p[i] for i in p if i != j) for j in p if j != k)
        for share, count in ((p[k], first[k]), (later, second[k])):
            assert abs(count / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 2e-3


def test_all_of_a_short_text(v):
    exact = every(v, "ab")
    row = pieces.sample(["ab"], np.array([3], np.uint64), v, 50)[0]
    assert {tuple(ids.tolist()) for ids, _, _ in row} == set(exact)
    assert all(q == 1.0 for _, _, q in row)


def test_round_trip_and_library_pieces(v):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = ["", " ", "  two  spaces ", "line\nbreak\ttab", "é𝛼ß 漢字 ▁mark", "x" * 500, "Word. " * 300]
    for text, row in zip(texts, pieces.sample(texts, np.arange(7, dtype=np.uint64), v, 3)):
        for ids, _, _ in row:
            assert pieces.decode(ids.tolist(), v) == text
            if "▁" not in text:
                assert model.decode(ids.tolist()) == text
                assert pieces.decode(model.encode(text), v) == text


def test_operator(spark, odd, none_at_all):
    got = pieces.segmentations(odd, k=2)
    rows = got.collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert Counter(r.doc_id for r in rows if r["rank"] == 0) == Counter(r.doc_id for r in odd.collect())
    again = pieces.segmentations(odd.repartition(5), k=2).collect()
    key = lambda r: (str(r.doc_id), r["rank"], r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert pieces.segmentations(none_at_all).count() == 0
