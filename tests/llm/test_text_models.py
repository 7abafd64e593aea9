import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import html_text, licenses, maxent, toxicity
from corpusloom.llm.common import hash_spans, utf8_view, words_of

from .conftest import WORDS, prose


# ---------------------------------------------------------------- hashed words
@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\t\n", max_size=20), max_size=8))
def test_words_are_told_apart(texts):
    h, bounds = words_of(pa.array(texts, pa.string()))
    want = [w for t in texts for w in t.encode().lower().split()]
    assert len(h) == len(want)
    assert list(np.diff(bounds)) == [len(t.encode().split()) for t in texts]
    seen = {}
    for a, b in zip(want, h):
        assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_segments_do_not_change_hashes(monkeypatch):
    text, offsets = utf8_view(pa.array([prose(500, 1)]))
    at = np.flatnonzero(text == 32)
    starts, ends = np.concatenate([[0], at + 1]), np.concatenate([at, [len(text)]])
    whole = hash_spans(text, starts, ends)
    monkeypatch.setattr("corpusloom.llm.common.SEGMENT", 50)
    assert (hash_spans(text, starts, ends) == whole).all()


# ---------------------------------------------------------------- language model
def test_lm_scores_against_counts(spark, odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    c = Counter()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    for k, t in rows:
        if not held(k):
            c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    got = maxent.lm_scores(odd).collect()
    want = Counter()
    for k, t in rows:
        w = [*t.encode().lower().split(), None]
        want[k, held(k), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def sentences(n, seed, rare=0.02, pool=500):
    """Texts in which the next word depends on the two before it, with some rare words."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(WORDS), r.choice(WORDS)]
        for _ in range(60):
            w.append(WORDS[(WORDS.index(w[-1]) * 3 + WORDS.index(w[-2]) + r.choice([0, 0, 0, 1])) % len(WORDS)] if w[-1] in WORDS and w[-2] in WORDS else r.choice(WORDS))
            if r.random() < rare:
                w.append(f"rare{r.randrange(pool)}")
        out.append((seed * 10_000 + i, " ".join(w)))
    return out


def test_lm_choices_sum_to_one(spark):
    docs = spark.createDataFrame(sentences(700, 3, 0.6, 10**6), "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 7 == 2)
    counts = maxent.count_words(docs.where("NOT held_out"))
    lexicon = maxent.Lexicon(*maxent.head_of(counts))
    tokens, words = maxent.cell_sums(counts, lexicon)
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    assert tokens.sum() + lexicon.counts[lexicon.types >= 0].sum() == whole.n and words.sum() + (lexicon.types >= 0).sum() == whole.v
    lexicon.cell_room = np.log10(np.maximum(tokens, 1))
    coded = maxent.typed(docs, lexicon, ["doc_id", "held_out"]).cache()
    model = maxent.train(coded.where("NOT held_out"), whole.n, lexicon)
    every = np.arange(maxent.START_TYPE)
    # every type ends in its own leaf, and after any history all types have probability one together
    assert len(set(zip(model.tree.path[:, 0], model.tree.path[:, 1], model.tree.path[:, 2]))) == len(every)
    for one, two in ((3, 5), (maxent.START_TYPE, maxent.START_TYPE), (20, 1)):
        p = np.exp(maxent.type_scores(model.weights, model.tree, every, np.full(len(every), one), np.full(len(every), two)))
        assert abs(p.sum() - 1) < 1e-4
    # within a cell the words seen and the unknown one share all
    cell = int(np.argmax(words))
    held = lexicon.counts[(lexicon.types < 0) & (lexicon.cells == cell)]
    assert len(held) == words[cell] and abs((10 ** lexicon.rare_score(held, np.full(len(held), cell))).sum() + lexicon.discount * words[cell] / tokens[cell] - 1) < 1e-9


def test_lm_beats_counts_on_held_out_texts(spark):
    docs = spark.createDataFrame(sentences(1500, 4), "doc_id long, text string")
    got = maxent.lm_scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    # twenty words in equal shares cost 1.3 each; what the history leaves open costs far less
    assert got.b / got.n < -1.25 and got.s / got.n > got.b / got.n + 0.25


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(sentences(120, 5), "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in maxent.lm_scores(docs.repartition(n)).collect()} for n in (1, 7))
    assert a == b


def test_lm_empty(spark, none_at_all):
    assert maxent.lm_scores(none_at_all).count() == 0


def small_tree(seed=0, kinds=200):
    r = np.random.default_rng(seed)
    table = np.concatenate([r.integers(0, 50, (kinds, 6)), r.integers(1, 400, (kinds, 1))], axis=1).astype(float)
    return maxent.Tree(table, kinds)


def slow_score(weights, tree, size, ty, one, two):
    """One token's log-probability by loops over the branches of each place on its path."""
    total = 0.0
    places = [0, 1 + tree.path[ty, 0], 1 + maxent.WIDTH + maxent.WIDTH * tree.path[ty, 0] + tree.path[ty, 1]]
    for level in range(tree.depth[ty]):
        rows = maxent.feature_rows(np.array([places[level]]), np.array([one]), np.array([two]), size)[:, 0]
        z = [sum(float(weights[r][b]) for r in rows) for b in range(maxent.WIDTH)]
        top = max(z)
        total += z[tree.path[ty, level]] - top - math.log(sum(math.exp(x - top) for x in z))
    return total


def test_lm_scores_against_loops():
    tree, size, r = small_tree(), 64, np.random.default_rng(1)
    weights = np.concatenate([tree.bias, r.standard_normal((3 * size, maxent.WIDTH)).astype(np.float32)])
    ty, one, two = (r.integers(0, 200, 60) for _ in range(3))
    got = maxent.type_scores(weights, tree, ty, one, two)
    want = [slow_score(weights, tree, size, *x) for x in zip(ty, one, two)]
    assert np.abs(got - want).max() < 1e-3


def test_lm_step_follows_the_gradient():
    tree, size, r = small_tree(3), 64, np.random.default_rng(2)
    weights = np.concatenate([tree.bias, 0.1 * r.standard_normal((3 * size, maxent.WIDTH))]).astype(np.float32)
    text = r.integers(0, 200, 40).astype("<u2")
    bounds = np.array([0, len(text)])
    types = text.astype(np.int64)
    one, two = maxent.histories(types, bounds)
    loss = lambda w: -maxent.type_scores(w, tree, types, one, two).sum()
    after, power, used = weights.copy(), np.ones(len(weights), np.float32), np.zeros(len(weights), np.float32)
    maxent.learn(after, tree, [text], 0.1, power, used)
    token, place, branch = tree.steps(types)
    assert used.sum() == 4 * len(token) and loss(after) < loss(weights)
    for row, col in {(int(maxent.feature_rows(place[i : i + 1], one[token[i : i + 1]], two[token[i : i + 1]], size)[k, 0]), int(branch[i])) for i in (0, 7, 50) for k in range(4)}:
        sides = []
        for h in (1e-2, -1e-2):
            moved = weights.astype(np.float64)
            moved[row, col] += h
            sides.append(loss(moved))
        slope = (sides[0] - sides[1]) / 2e-2
        # the step is the gradient over the root of what the row has gathered
        assert abs((weights[row, col] - after[row, col]) - 0.1 * slope / math.sqrt(power[row])) < 2e-3


# ---------------------------------------------------------------- toxicity
def test_toxicity_holds_out_and_learns(spark, odd, none_at_all):
    docs = [(i, prose(30, i) + (" you vile fool" if i % 4 == 0 else "") + prose(30, 900 + i)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id as string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, toxicity.toxicity(frame, flipped).collect())) == sorted(map(tuple, got))
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(none_at_all, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()


def test_ftrl_against_loops():
    p = toxicity.Ftrl(bits=6, epochs=2, min_texts=1, l1=0.05)
    r = np.random.default_rng(4)
    examples = [(np.unique(r.integers(0, 64, 9)).astype(np.uint32), int(r.random() < 0.4)) for _ in range(60)]
    examples += [(np.array([1, 2], np.uint32), 1)] * 3  # repeats teach once
    kept, weights, bias = toxicity.fit(examples, p)
    z, n, z0, n0 = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    once = list({tuple(c): (c, y) for c, y in examples}.values())
    share = sum(y for _, y in once) / len(once)
    start = math.log(share / (1 - share))
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for cells, y in once:
            b = start - z0 / ((p.beta + math.sqrt(n0)) / p.alpha + p.l2)
            g = 1 / (1 + math.exp(-(sum(weight(int(i)) for i in cells) + b))) - y
            for i, w in [(int(i), weight(int(i))) for i in cells]:
                rise = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - rise * w
                n[i] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / p.alpha * (b - start)
            n0 += g * g
    assert list(kept) == [i for i in range(64) if abs(z[i]) > p.l1]
    assert np.allclose(weights, [weight(int(i)) for i in kept])


# ---------------------------------------------------------------- pages
PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="cookie-notice">We use cookies here</div>
%s<aside>See also this</aside><form>Name <input></form><footer>&copy; someone</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First  para\n with <b>bo</b>ld words &#233; and more of them.<br><p>Second para runs on for a while too.</p>"
TEXT = "A & B First para with bold words é and more of them. Second para runs on for a while too."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<article>%s<div class='comments'><p>A reader says a lot here</p></div></article>", "<div id=x>%s</div><div id='comments'><p>A reader says a lot here, twice</p></div>"])
def test_main_text(wrap):
    learned = html_text.weigh(sum((html_text.tally(html_text.parse(PAGE % f"<article>{BODY}</article>")) for _ in range(20)), Counter()))
    assert html_text.main_text(html_text.parse(PAGE % (wrap % BODY)), learned) == TEXT


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run_by_brute_force(scores):
    a, b = html_text.best_run(np.array(scores, float))
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[a:b]) == best


def test_pages_operator(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>"), (2, "u", None), (3, None, ""), (4, "v", "<p"), (4, "v", "<p"), (5, "w", "<p>" * 20_000 + "deep text" + "</div>" * 5000)]
    got = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == TEXT and by[2].text == by[3].text == "" and by[1].n_chars == len(TEXT) and len(got) == 6
    assert html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- licenses
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_increasing_by_brute_force(values):
    kept = [values[i] for i in licenses.increasing(values)]
    assert all(a < b for a, b in zip(kept, kept[1:]))
    subsets = ([v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values)))
    assert len(kept) == max(len(s) for s in subsets if all(a < b for a, b in zip(s, s[1:])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_alignments_are_ordered_matches(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))
    assert len(licenses.align(a, a)) == len(a)


def test_notices_are_found(spark, none_at_all):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, notice in licenses.TEMPLATES.items():
        for text in (notice, prose(300, 2) + "\n" + notice + "\n" + prose(300, 3), notice + " " + notice):
            found = scanner.scan(text)
            assert {f[0] for f in found} == {name} and all(c >= 0.8 for _, c, _, _ in found)
            assert len(found) == text.count(notice)
            assert all(text[a:b] == notice.rstrip(".") or notice.startswith(text[a:b][:20]) for _, _, a, b in found)
    assert scanner.scan(prose(5000, 4)) == [] and scanner.scan("") == []
    rows = [(1, prose(50, 1) + " Released under the MIT License. "), (2, None), (3, "license"), (3, "license")]
    got = licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licenses) for r in got) == [(1, "MIT line"), (2, ""), (3, ""), (3, "")]
    assert licenses.license_spans(none_at_all).count() == 0


def test_toxicity_learns_from_each_text_once(spark):
    """Repeated rows and a bound on bytes: what the one learning task holds is bounded, and repeats change nothing."""
    from corpusloom.llm import toxicity

    base = [(i, prose(30, i) + (" vile awful" if i % 2 else " kind nice")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    p = toxicity.Ftrl(min_texts=2)
    once = toxicity.train(spark.createDataFrame(base, "doc_id long, text string"), labels, p, None)
    many = toxicity.train(spark.createDataFrame(base + base[:3] * 10_000, "doc_id long, text string").repartition(8), labels, p, None)
    assert all(np.array_equal(a, b) for a, b in zip(once[:2], many[:2])) and once[2] == many[2] and len(once[0])
    few = toxicity.train(spark.createDataFrame(base, "doc_id long, text string"), labels, toxicity.Ftrl(min_texts=2, bytes=100), None)
    assert not len(few[0])
