import itertools
import random
import re

import numpy as np
import pytest

from corpusloom.llm import pii
from corpusloom.llm.lstm_crf import GRAIN, Tagger

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def tagger():
    return pii.shipped()


def test_base_spans_equal_patterns():
    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choices("ab1234.@+-() %é", k=r.randint(0, 60)))
        assert plain(text) == pii.base_spans(text), text
    for text, _ in pii.generated(500, seed=5):
        assert plain(text) == pii.base_spans(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_held_out_accuracy(tagger):
    held = pii.generated(300, seed=1234)
    found = pii.learned_spans([t for t, _ in held], tagger)
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(held, found))
    assert hit / sum(len(s) for _, s in held) > 0.95
    assert hit / max(1, sum(map(len, found))) > 0.97


def test_stretches_decode_as_whole_texts(tagger):
    """Searching only where a span can gain gives the tags of the search over everything, for long texts and short ones."""
    texts = [t for t, _ in pii.generated(60, seed=8)]
    texts += [" ".join(texts[:12]), "nothing of the kind " * 40, "7", "@", "", "1.2.3.4 " * 50, "x" * 700 + " 4111111111111111 " + "y" * 700]
    coded = [pii.symbols(t) for t in texts]
    quick = tagger.decode(coded)
    e, begins = tagger.scores(coded)
    for x, a, b, got in zip(coded, begins[:-1], begins[1:], quick):
        assert len(got) == len(x) == b - a - 1
        if len(x):
            assert (tagger._viterbi([e[a : b - 1]])[0] == got).all()


def test_windows_of_all_lengths_run_together(tagger, monkeypatch):
    """Texts of every length take the steps of the longest once, and each has the scores of a plain run over it alone."""
    prose = " ".join(t for t, _ in pii.generated(40, seed=6))
    coded = [pii.symbols(prose[n : 2 * n]) for n in range(2, 512, 3)]
    calls, run = [], tagger.emissions
    monkeypatch.setattr(tagger, "emissions", lambda *windows: calls.append(1) or run(*windows))
    e, begins = tagger.scores(coded)
    assert len(calls) == 1
    for x, at in zip(coded, begins):
        padded = np.zeros((1, -(-len(x) // GRAIN) * GRAIN), np.int64)
        padded[0, : len(x)] = x
        both = np.concatenate([tagger._run(d, tagger.p["E"][padded], None) for d in "fb"], axis=2)
        assert np.allclose((both @ tagger.p["O"] + tagger.p["o"])[0, : len(x)], e[at : at + len(x)], atol=1e-3)


def test_tags_are_the_best_of_all():
    r = np.random.default_rng(2)
    tagger = Tagger(1, hidden=4, embed=3, seed=9)
    tagger.p["A"] = r.standard_normal((3, 3)).astype(np.float32)
    A = tagger.p["A"] + tagger.banned
    for _ in range(40):
        e = (r.standard_normal((6, 3)) * 2).astype(np.float32)
        worth = lambda y: A[0, y[0]] + A[y[-1], 0] + tagger.first[y[0]] + sum(e[t, y[t]] for t in range(6)) + sum(A[y[t], y[t + 1]] for t in range(5))
        best = max(itertools.product(range(3), repeat=6), key=worth)
        tags = np.zeros(6, np.int8)
        for a, b in tagger._stretches(e):
            tags[a:b] = tagger._viterbi([e[a:b]])[0]
        assert tuple(tags) == best


def test_training_learns_and_gradients_hold():
    labelled = pii.generated(300, seed=2)
    fresh = Tagger(len(pii.KINDS))
    chars, tags = pii.windows_of(labelled)
    loss, grads = fresh._gradients(chars[:8], tags[:8])
    for name, at in (("fh", (2, 5)), ("bx", (1, 7)), ("O", (3, 2)), ("A", (0, 1)), ("E", (int(chars[0][0]), 1))):
        old = fresh.p[name][at]
        sides = []
        for step in (1e-2, -1e-2):
            fresh.p[name][at] = old + step
            sides.append(fresh._gradients(chars[:8], tags[:8])[0])
        fresh.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][at]) < 0.05 * max(1, abs(grads[name][at])), name
    assert pii.train(labelled, epochs=3)._gradients(chars, tags)[0] < 0.5 * loss


def test_saved_weights_come_back(tagger, tmp_path, monkeypatch):
    pii.save(tagger, str(tmp_path / "w.json"))
    with open(tmp_path / "w.json") as a, open(pii.WEIGHTS) as b:
        assert a.read() == b.read()


def test_find_and_redact(spark, odd, none_at_all, tagger):
    rows = [(1, "write to ann.lee@mail.example.com or +1 (212) 555-0100 now"), (2, "nothing to see, version 2.0"), (3, None), (4, ""), (5, "host 10.0.0.1 and 300.1.1.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs, tagger).collect()}
    assert (got[1].n_email, got[1].n_phone, got[5].n_ip, got[2].n_card) == (1, 1, 1, 0)
    assert got[3].spans == got[4].spans == "" and got[3].base_sha256 == got[2].base_sha256
    clean = {r.doc_id: r.text for r in pii.redact(docs, tagger).collect()}
    assert clean[1] == "write to [EMAIL] or [PHONE] now" and clean[2] == rows[1][1] and clean[3] is None
    assert pii.redact(odd, tagger).columns == odd.columns and pii.redact(odd, tagger).count() == odd.count()
    assert pii.find(none_at_all, tagger).count() == 0


def test_whole_addresses_are_read_and_widened():
    r = random.Random(3)
    forms = ["joe [at] abcde [dot] example [dot] com", "mail3@mail3 [dot] abcdefg [dot] example [dot] com", "a" * 40 + "1b@host.example.com", "ann (at) mail1 (dot) abcdefg (dot) co (dot) uk"]
    forms += [t[a:b] for t, spans in pii.generated(400, seed=21) for kind, a, b in spans if kind == "email"]
    for form in forms:
        text = "w" * 30 + " " + form + " " + "v" * 30
        a, b = 31, 31 + len(form)
        sign = pii.SIGN.search(form)
        for cut in (len(form), r.randint(sign.end() + 1, len(form))):
            assert pii._settled(text, "email", 31 + sign.start() - 1, 31 + cut) == ("email", a, b), form
