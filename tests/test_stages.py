"""Canonicalization, recall, the instrument, the graph, schemas and the stages that ask a model again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.numbers import rounded
from corpusloom.operators import canonical, evaluation, graph, instrument, recall, units
from corpusloom.plans import schemas, stages
from corpusloom.sources import artifacts

from .records import beat, entity, frame, unit


class Says:
    """Answers each prompt by the first rule whose key it holds; counts what it was asked."""

    name = "says"

    def __init__(self, **rules):
        self.rules = rules

    def generate_batch(self, prompts, max_tokens=None):
        return [next((a if isinstance(a, str) else a(p)) for k, a in self.rules.items() if k in p or k == "other") for p in prompts]


NAMES = [
    ("Kogut and Susskind", "person"), ("Kogut-Susskind Hamiltonian", "other"), ("embedding approach", "method"), ("embedding method", "method"), ("enlarged Hilbert space", "other"), ("larger Hilbert space (working space)", "other"),
    ("weakly coupled Yang-Mills theories", "theory"), ("weakly coupled gauge theories", "model"), ("Loop!", "concept"), ("loop", "object"),
]


def test_groups_are_parted_by_class(spark):
    mentions = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(NAMES)], "doc_id int, pos int, name string, type string")
    answer = json.dumps({"alias_groups": {"Kogut-Susskind Hamiltonian": ["Kogut and Susskind", "Kogut-Susskind Hamiltonian"], "embedding approach": ["embedding approach", "embedding method"], "larger Hilbert space": [NAMES[4][0], NAMES[5][0]], NAMES[6][0]: [NAMES[6][0], NAMES[7][0]]}})
    groups = canonical.all_groups(mentions, canonical.groups_of(spark.createDataFrame([(1, answer)], "doc_id int, response string")))
    got = {r.original: r for r in canonical.canonicalized(mentions, groups).collect()}
    assert got["embedding method"].name == "embedding approach" and got["embedding method"].entity_id == "embedding_approach"
    assert got["embedding method"].aliases == ["embedding approach", "embedding method"]
    for i, j in ((0, 1), (4, 5), (6, 7)):
        assert got[NAMES[i][0]].entity_id != got[NAMES[j][0]].entity_id
    assert got["loop"].name == "Loop!" and got["loop"].type == "concept"
    # an answer that can't be read leaves the fallback alone
    plain = canonical.all_groups(mentions, canonical.groups_of(spark.createDataFrame([(1, "no json")], "doc_id int, response string")))
    assert plain.count() == 9
    rel = canonical.retargeted(spark.createDataFrame([(1, "Embedding Method"), (1, "nobody")], "doc_id int, target string"), groups).collect()
    assert {(r.target, r.target_id) for r in rel} == {("embedding approach", "embedding_approach"), ("nobody", None)}


def test_recall_and_fidelity(spark):
    text = "12 HEADING\n7OMITTED 7\nAna has 47 boxes on 2-19-98 at 3,500.\n9CLOSE ON DOOR 9\nsent 3/3/98 p. 4\n(MORE)"
    source = spark.createDataFrame([("s1", text, "INT", "Pier 9", ["ANA", "COP", "CLICK."], ["3/3/98"])], "scene_id string, text string, kind string, location string, speakers array<string>, stamps array<string>")
    rows = lambda said: recall.recalled(source, spark.createDataFrame([("s1", said)], "scene_id string, blob string"))
    got = {(r.kind, r.value): r.hit for r in rows("ana counted 47 on 19.2.98, day 2 of 19 98 at the pier").collect()}
    assert got == {("number", "47"): True, ("number", "2-19-98"): True, ("number", "3,500."): False, ("name", "ANA"): True, ("location", "Pier 9"): True} or ("number", "3,500") in got
    none = spark.createDataFrame([], "scene_id string, number string, original string")
    assert recall.fidelity(rows("nothing"), none).first().status == "warn"
    drift = spark.createDataFrame([("s1", "48", "47")], "scene_id string, number string, original string")
    assert recall.fidelity(rows("48"), drift).first().status == "fail"


def test_sample_is_the_generators(spark):
    scenes = [(i, 10 + (i * 37) % 90) for i in range(60)]

    def slow(count, seed):
        left = sorted(s for s in scenes if s[1] >= 20)
        strata = [x[j::3] for i in range(3) for x in [sorted(left[i::3], key=lambda s: s[1])] for j in range(3)]
        rng, picked = random.Random(seed), []
        while len(picked) < count and any(set(s) - set(picked) for s in strata):
            for s in strata:
                pool = [x for x in s if x not in picked]
                if pool and len(picked) < count:
                    picked.append(rng.choice(pool))
        return sorted(i for i, _ in picked)

    for count in (5, 25, 500):
        assert instrument.drawn(scenes, count) == slow(count, 20260819)
    df = spark.createDataFrame([(d, i, w) for d in (1, 2) for i, w in scenes], "doc_id int, scene_index int, word_count int")
    assert sorted(r.scene_index for r in instrument.sampled_scenes(df, 25).where("doc_id = 2").collect()) == slow(25, 20260819)


def test_statistics_follow_the_generators(spark):
    rows = [(f"d{i % 7}", i, c, int((i * k) % 3 == 0)) for i in range(60) for k, c in ((1, "original"), (2, "knowledge_units"))]
    df = spark.createDataFrame(rows, "doc string, i int, cond string, correct int").withColumn("g", F.lit("g"))
    got = {r.condition: r for r in evaluation.cluster_bootstrap(df, "g", "doc", condition="cond", order="i", versus=("knowledge_units", "original"), resamples=300).collect()}
    docs = [f"d{i}" for i in range(7)]
    rng, samples = random.Random(evaluation.SEED), {"original": [], "knowledge_units": []}
    for _ in range(300):
        pick = [rng.choice(docs) for _ in docs]
        for c, out in samples.items():
            hit = [r[3] for d in pick for r in rows if r[0] == d and r[2] == c]
            out.append(sum(hit) / len(hit))
    for c, v in samples.items():
        v = sorted(v)
        assert (got[c].low, got[c].high) == pytest.approx((v[int(0.025 * 300)], v[int(0.975 * 300) - 1]))
    diff = sorted(a - b for a, b in zip(samples["knowledge_units"], samples["original"]))
    assert got["knowledge_units-original"].low == pytest.approx(diff[7])
    cells = spark.createDataFrame([("a", f"q{i:02}", i % 4, 4) for i in range(20)] + [("b", "q", 0, 0)], "arm string, question_id string, correct int, total int")
    ci = {r.arm: r for r in evaluation.question_bootstrap(cells, resamples=200).collect()}
    rng, x = random.Random(7), [(i % 4) / 4 for i in range(20)]
    means = sorted(sum(x[rng.randrange(20)] for _ in range(20)) / 20 for _ in range(200))
    assert (ci["a"].low, ci["a"].high) == pytest.approx((means[5], means[195])) and ci["b"].low == 0.0
    values = [2.675, 0.5, 1.005, -2.5, 1e-9]
    shown = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(2)("x")).collect()
    assert [r[0] for r in shown] == [round(v, 2) for v in values]


def test_leaking_questions_are_asked_again_or_dropped(spark):
    source = spark.createDataFrame([(1, "the old man walked down to the quiet harbour before dawn")], "source_id int, text string")
    schema = "scene_id string, question_id string, question string, options array<string>, correct_index int, fact_type string"
    q = lambda s, text: (s, f"{s}-q1", text, ["a", "b", "c", "d"], 0, "cause")
    start = spark.createDataFrame([q("s1", "who walked down to the quiet harbour?"), q("s2", "what then?"), q("s3", "old man walked down to the quiet")], schema)
    again = lambda bad: spark.createDataFrame([q(r.scene_id, "why so early?" if r.scene_id == "s1" else "the old man walked down to the") for r in bad.collect()], schema)
    kept, dropped = instrument.without_leaks(start, source, again)
    assert {(r.scene_id, r.question) for r in kept.collect()} == {("s1", "why so early?"), ("s2", "what then?")}
    assert [(r.question_id, r.run_words) for r in dropped.collect()] == [("s3-q1", 7)]
    units_ = spark.createDataFrame([(1, f"s{i}", i, f"D{i}") for i in range(5)], "doc_id int, scene_id string, scene_index int, digest string")
    asked = spark.createDataFrame([(1, "s0"), (1, "s9")], "doc_id int, scene_id string")
    got = {arm: {r.scene_id: r.context for r in instrument.contexts(asked, units_, arm).collect()} for arm in ("none", "own", "near", "whole")}
    assert got["near"] == {"s0": "D0\n\nD1\n\nD2", "s9": ""} and got["own"]["s0"] == "D0" and got["none"]["s0"] == "" and got["whole"]["s9"].endswith("D4")


def test_research_changes_only_what_it_knows(spark):
    o = spark.createDataFrame([("a", "plausible"), ("b", "probable")], "ao_id string, confidence string")
    ev = spark.createDataFrame([("a", "s#1", "supports"), ("z", "s#1", "supports")], "ao_id string, beat_ref string, stance string")
    links = spark.createDataFrame([("a", "b"), ("a", "z"), ("z", "a")], "from_ao string, to_ao string")
    up = spark.createDataFrame([("a", 0, "speculative", ""), ("a", 1, "probable", ""), ("b", 0, "no such", ""), ("z", 0, "probable", "")], "ao_id string, ord int, new_confidence string, why string")
    objects, evidence, kept, history = graph.researched(o, ev, links, up, 1)
    assert {(r.ao_id, r.confidence) for r in objects.collect()} == {("a", "probable"), ("b", "probable")}
    assert evidence.count() == 1 and kept.count() == 1
    assert [(r["from"], r["to"], r.step) for r in history.orderBy("ord").collect()] == [("plausible", "speculative", -1), ("speculative", "probable", 1)]
    scenes, beats = spark.createDataFrame([(1, "s1")], "window int, scene_id string"), spark.createDataFrame([(1, "s1#1")], "window int, ref string")
    found = spark.createDataFrame([(1, 0, "s1", ["s1#1"]), (1, 1, "s1", ["s1#9"]), (1, 2, "s2", ["s1#1"]), (1, 3, "s1", [])], "window int, ord int, scene_id string, grounded_in array<string>")
    assert [r.ao_id for r in graph.new_objects(found, scenes, beats, 2).collect()] == ["ao-w001-r2-000"]
    change = "ref string, entity string, field string, `from` string, `to` string"
    known = spark.createDataFrame([("s1#1", "e", "f", "x", "y")], change)
    wrong = spark.createDataFrame([("s1#1", "e", "f", 0, "p", "c")], "ref string, entity string, field string, ord int, problem string, correction string")
    got = graph.state_changes(known, beats, spark.createDataFrame([("s1#1", "e", "g", None, "z"), ("s1#7", "e", "g", None, "z")], change), wrong).collect()
    assert {(r.ref, r.field, r.added, r.problem) for r in got} == {("s1#1", "f", False, "p"), ("s1#1", "g", True, None)}


def test_schemas():
    ids = ["s1"]
    every = [schemas.extraction(ids), schemas.canary(), schemas.seam(["a"], ids), schemas.draft(["s1#1"], ["a"], ids, True), schemas.research(["s1#1"], ["a"], ["x"], ids), schemas.merge(["x", "y"]), schemas.editor(["n"]), schemas.questions(2), schemas.restatement()]
    for s in every:
        safe = json.dumps(schemas.grammar_safe(s))
        assert not any(f'"{k}"' in safe for k in schemas.UNSUPPORTED) and json.loads(safe)["type"] == "object"
    assert schemas.grammar_safe({"properties": {"not": {"type": "string", "not": {}}}, "items": [{"oneOf": []}]}) == {"properties": {"not": {"type": "string"}}, "items": [{}]}
    assert schemas.faults({"restated": "long enough to stay"}, schemas.restatement()) == []
    assert schemas.faults({"restated": "short"}, schemas.restatement()) == ["$.restated: too short"]
    assert schemas.faults({"questions": [{}]}, schemas.questions(1)) and schemas.faults([], schemas.merge(["x"])) == ["$: no object"]
    link = {"from_ao": "x", "to_ao": "q", "link": "causes", "why": ""}
    assert schemas.faults({"cross_links": [link], "duplicates": [], "arcs": []}, schemas.merge(["x"])) == ["$.cross_links[0].to_ao: 'q' is not allowed"]


def test_windows_are_asked_twice_and_fields_restated(spark):
    windows = spark.createDataFrame([(0, ["s1"], "first"), (1, ["s2"], "second"), (2, ["s3"], "third")], "window int, scene_ids array<string>, prompt string")
    good = lambda s: json.dumps({"knowledge_units": [{"scene_id": s}]})
    model = Says(first=good("s1"), second=lambda p: good("s2") if "rejected" in p else good("s9"), third="no json")
    got = {r.window: r for r in stages.extracted(windows, model).collect()}
    assert got[0].scene_id == "s1" and got[1].scene_id == "s2" and "no JSON" in got[2].error and got[2].unit is None
    assert stages.canary_emitted(windows.select("prompt"), Says(first=good("s1"), other='{"knowledge_units": []}')) == 1
    source = spark.createDataFrame([("s1", "the brass lantern swung slowly above the frozen wooden landing stage")], "scene_id string, text string")
    fields = spark.createDataFrame([("p1", "a brass lantern swung slowly above the frozen wooden landing stage"), ("p2", "all calm")], "path string, text string")
    done, report = stages.restated(fields, source, Says(other='{"restated": "some lamp moved over the pier"}'))
    assert {r.path: r.text for r in done.collect()} == {"p1": "some lamp moved over the pier", "p2": "all calm"}
    assert [(r.round, r.flagged) for r in report.orderBy("round").collect()] == [(1, 1), (2, 0)]
    stuck, report = stages.restated(fields, source, Says(other='{"restated": "short"}'), rounds=2)
    assert stuck.where("path = 'p1'").first().text.startswith("a brass") and report.count() == 2


def test_seams_and_editor(spark):
    shown = spark.createDataFrame([(1, w, 10 * w + i, f"U{w}{i}") for w in range(3) for i in range(4)], "doc_id int, window int, scene_index int, digest string")
    seen = []
    answer = json.dumps({"alias_merges": [{"keep": "ana", "merge": ["anna", "ana"]}], "context_fixes": [{"scene_id": "s1", "field": "context_after", "replacement": "too short"}]})
    got = stages.seam_answers(shown, Says(other=answer))
    assert {(r.left_window, r.right_window) for r in got.collect()} == {(0, 1), (1, 2)}
    merges, fixes = stages.seam_merges(got)
    assert {(r.alias, r.canonical) for r in merges.collect()} == {("anna", "ana")} and not fixes.count()

    def reply(p):
        seen.append(p)
        return json.dumps({"canonical_map": [{"canonical": "N00", "variants": ["N01", "N00"]}, {"canonical": "", "variants": ["N02"]}]})

    assert stages.edited([f"N{i:02}" for i in range(90)], Says(other=reply)) == {"N01": "N00"}
    assert len(seen) == 3 and '"N01": "N00"' in seen[1]
    names = spark.createDataFrame([(1, "N00"), (1, "N01"), (2, "x")], "doc_id int, name string")
    fixed = json.dumps({"canonical_map": [{"canonical": "N00", "variants": ["N01"]}]})
    assert {(r.doc_id, r.alias) for r in stages.edited_names(names, Says(N00=fixed, other="{}")).collect()} == {(1, "N01")}


def test_artifacts(spark, tmp_path):
    old = {"knowledge_units": [{"entities": [{"name": "Ana", "type": "person", "relations": [{"target": "Bo"}]}]}]}
    (tmp_path / "u.json").write_text(json.dumps(old))
    u = artifacts.read_units(spark, str(tmp_path / "u.json")).first()
    assert (u.schema_version, u.chunk_index, u.entities[0].entity_type, u.entities[0].relationships[0].predicate) == ("1.0", 0, "person", "related_to")
    (tmp_path / "j.json").write_text(json.dumps({"rows": [{"document_id": "d", "question_index": 0, "gold": "A", "predictions": {"original": "A", "no_context": None}}]}))
    got = {r.condition: r.pred for r in artifacts.read_judged(spark, str(tmp_path / "j.json")).collect()}
    assert got == {"original": "A", "no_context": None}
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question_id": "q", "scene_id": "s1", "question": "who?", "options": ["a", "b", "c", "d"], "correct_index": 1}]}))
    q = artifacts.read_instrument(spark, str(tmp_path / "q.json"))
    scene = spark.createDataFrame([("s1", "one\ntwo")], "scene_id string, text string")
    beats = spark.createDataFrame([("s1", 1, "ana", "comes")], "scene_id string, `order` int, actor string, content string")
    shown = artifacts.worked_example(scene, beats, q)
    assert "> two" in shown and "| 1 | ana | comes |" in shown and "* **b**" in shown
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    with pytest.raises(ValueError):
        artifacts.with_cache(docs, docs.limit(1))
    assert artifacts.with_cache(docs, docs.withColumn("x", F.lit(1))).count() == 2
    artifacts.write_result(docs.limit(1), str(tmp_path / "one.json"))
    artifacts.write_result(docs, str(tmp_path / "two.json"))
    assert isinstance(json.loads((tmp_path / "one.json").read_text()), dict) and len(json.loads((tmp_path / "two.json").read_text())) == 2


def test_beats_put_in_one_after_the_other(spark):
    u = frame(spark, unit("s1", beats=[beat(i, f"old {i}") for i in (1, 2)]))
    new = spark.createDataFrame([("s1", 0, 0, "action", "a", None, "first"), ("s1", 1, 1, "action", "a", None, "second"), ("s1", 99, 2, "action", "a", None, "last")], "scene_id string, after_order int, ord int, type string, actor string, addressee string, content string")
    got = graph.perceived(u, new).first().beats
    assert [(b.order, b.content) for b in got] == [(1, "first"), (2, "second"), (3, "old 1"), (4, "old 2"), (5, "last")]


def test_gated_runs(spark, tmp_path):
    from corpusloom.__main__ import main

    beats = [beat(1, "Ana hears that one box is missing from the load"), beat(2, "She asks how 47 of them could be signed for", type="speech", causes=[1])]
    u = frame(spark, unit("s1", context_before="before all this nothing is known", context_after="after it they part in silence", style="short plain lines without colour", referenced=[], beats=beats, entities=[entity("ana")]))
    scene = spark.createDataFrame([("s1", "HEADING\nAna counts 47 boxes twice on the quay.", "EXT", "", ["ANA"], [])], "scene_id string, text string, kind string, location string, speakers array<string>, stamps array<string>")
    objects = spark.createDataFrame([("a1", "theory_of_mind", "s1", "Ana suspects that someone lied to her", ["s1#1"], "she asks twice", "plausible", "a receipt", None), ("a2", "hypothesis", "s1", "the load was short from the start", ["s1#2"], "numbers differ", "probable", "a full hold", None)], "ao_id string, type string, scene_id string, statement string, grounded_in array<string>, reasoning string, confidence string, falsifier string, superseded_by string")
    tables = {"units": u, "scenes": scene, "objects": objects, "links": spark.createDataFrame([("a1", "a2")], "from_ao string, to_ao string"), "evidence": spark.createDataFrame([("a1", "contradicts")], "ao_id string, stance string")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "t" / name))
    every = [x for i in range(1, 8) for x in ("--verified", f"C{i}")]
    assert main(["gate-scenes", str(tmp_path / "t"), str(tmp_path / "a"), "--canary-emitted", "0", *every]) == 0
    assert {r.status for r in spark.read.parquet(str(tmp_path / "a" / "protocol")).collect()} == {"pass"}
    assert main(["gate-scenes", str(tmp_path / "t"), str(tmp_path / "b"), "--canary-emitted", "2", *every]) == 1
    assert (tmp_path / "b" / "quarantine").is_dir() and (tmp_path / "b" / "raw").is_dir()
    assert main(["gate-graph", str(tmp_path / "t"), str(tmp_path / "c")]) == 0
    assert spark.read.parquet(str(tmp_path / "c" / "protocol")).count() == 8


def test_documents_are_resolved_by_a_model(spark):
    from corpusloom.plans import extraction

    docs = spark.createDataFrame([(1, "Anna Karlsen came. Then Anna Karlsson left with Boris."), (2, "nothing here."), (3, "Karl saw Boris.")], "doc_id int, text string")

    class Reader:
        name = "reader"

        def generate_batch(self, prompts, max_tokens=None):
            names = ["Anna Karlsen", "Anna Karlsson", "Boris", "Karl"]
            out = []
            for p in prompts:
                if "PAIRS TO LOOK AT" in p:
                    assert '["Anna Karlsen","Anna Karlsson"]' in p or "Karl\"" in p
                    out.append(json.dumps({"alias_groups": {"Anna Karlsen": ["Anna Karlsen", "Anna Karlsson"]}}) if "Karlsson" in p else "no idea")
                else:
                    target = p.rsplit("TARGET", 1)[1]
                    out.append(json.dumps({"context_summary": "s", "entities": [{"name": n, "type": "person"} for n in names if n in target]}))
            return out

    units_ = extraction.extract(docs, Reader())
    answers = extraction.resolver_answers(units_, Reader())
    assert {r.doc_id for r in answers.collect()} == {1, 3}
    got = {(r.doc_id, r.canonical_id): (r.aliases, r.mentions) for r in extraction.canonical(units_, answers).collect()}
    assert got[1, "anna_karlsen"] == (["Anna Karlsen", "Anna Karlsson"], 2) and (3, "karl") in got
