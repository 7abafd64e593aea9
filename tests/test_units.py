import random

from pyspark.sql import functions as F

from corpusloom.operators import checks, sampling, units

from .records import beat, entity, frame, unit


def test_fields_and_refs(spark):
    change = {"entity": "ana", "field": "mood", "from": None, "to": "tense"}
    full = unit(
        beats=[beat(1, "Ana waits", state_changes=[change, change | {"from": "calm", "to": ""}]), beat(None, "no place")], present=None,
        entities=[entity("ana", attributes={"tone": "flat", "none": None}, relationships=[{"predicate": "knows", "target": "the narrator", "target_id": "narrator"}]), entity("x", attributes=None, relationships=None)],
    )
    got = sorted((r.path, r.text) for r in units.text_fields(frame(spark, full)).collect())
    assert got == sorted(
        [
            ("beats[1].content", "Ana waits"), ("beats[1].state_changes.field", "mood"), ("beats[1].state_changes.field", "mood"), ("beats[1].state_changes.from", "calm"), ("beats[1].state_changes.to", "tense"), ("beats[None].content", "no place"),
            ("context_before", "before that nothing of note"), ("context_after", "after that nothing of note"), ("style", "short and plain sentences"), ("entities[ana].attributes", "flat"), ("entities[ana].relationships.target", "the narrator"),
        ]
    )
    ids = sorted((r.path, r.entity_id) for r in units.used_ids(frame(spark, full)).collect())
    assert ids == [("beats[1].actor", "ana"), ("beats[1].state_changes.entity", "ana"), ("beats[1].state_changes.entity", "ana"), ("beats[None].actor", "ana"), ("referenced", "boris"), ("relationships.target_id", "narrator")]
    df = frame(spark, unit())
    assert [r.ref for r in units.beat_refs(df).orderBy("order").collect()] == ["sc-1#1", "sc-1#2", "sc-1#3"]


def test_rendering(spark):
    said = unit(
        heading={"raw": "INT. QUAY"}, context_before=None, present=["ana", "boris"],
        beats=[beat(1, "asks", type="speech", addressee="boris", facts={"quantities": ["47"], "dates": ["the 14th"], "proper_nouns": ["Pier"], "locations": None}, state_changes=[{"entity": "boris", "field": "mood", "from": None, "to": "tense"}]), beat(2, "leaves", actor="")],
    )
    body = "Present: ana, boris\n1. [speech] ana -> boris: asks  [47; the 14th]\n     ~ boris.mood: None -> tense\n2. [action] ?: leaves"
    text = lambda u, v: units.rendered(frame(spark, u), v).first().digest
    assert text(said, "full") == f"## sc-1 | INT. QUAY\n{body}\nAfter: after that nothing of note"
    assert text(said | {"context_before": "earlier"}, "brief") == f"## sc-1 | INT. QUAY\nBefore: earlier\n{body}"
    assert text(said | {"context_before": "earlier", "heading": None}, "minimal") == f"## sc-1 | (no heading)\n{body}"
    assert text(unit(beats=None, present=None), "minimal") == "## sc-1 | (no heading)"
    docs = spark.createDataFrame([("d", "T", None, "1998", ""), ("e", None, None, None, None)], "doc_id string, title string, draft string, draft_date string, credited_as string")
    two = frame(spark, unit("sc-2", 1, beats=[]), unit("sc-1", 0, beats=[])).withColumn("doc_id", F.lit("d"))
    got = {r.doc_id: r for r in units.rendered_chain(two, docs, verbosity="minimal").collect()}
    head = "Credited as: unknown\nScenes in order. Each scene lists its beats in the order the audience receives them.\n"
    assert got["d"].chain == f"KNOWLEDGE UNITS — T (draft unknown, 1998)\n{head}## sc-1 | (no heading)\nPresent: ana\n\n## sc-2 | (no heading)\nPresent: ana"
    assert got["e"].chain == f"KNOWLEDGE UNITS — untitled (draft unknown, date unknown)\n{head}" and got["d"].tokens == int(len(got["d"].chain) / 3.6)


def test_errors_and_closure(spark):
    expected = spark.createDataFrame([("sc-1",)], "scene_id string")
    assert not units.unit_errors(frame(spark, unit()), expected).count()
    beats = unit()["beats"]
    for rows, said in (
        ([unit(style="x")], "context or style too short"), ([unit(beats=[])], "no beats"), ([unit(beats=beats[1:])], "orders not 1 to n"), ([unit(beats=[beats[0] | {"certainty": "sure"}])], "unknown type or certainty"),
        ([unit(beats=[beats[0] | {"content": "short     "}])], "content too short"), ([unit(beats=[beats[0] | {"causes": [1]}])], "cause not before"), ([unit(), unit()], "not exactly once"), ([unit("sc-9")], "not exactly once"),
    ):
        assert said in {r.error for r in units.unit_errors(frame(spark, *rows), expected).collect()}, said
    change = {"entity": "ghost", "field": "mood", "from": None, "to": "tense"}
    open_ = frame(spark, unit(present=["ana", "old_man"], beats=[beat(1, "something happens", state_changes=[change])], entities=[entity("ana", relationships=[{"predicate": "knows", "target": "him", "target_id": "old_man"}])]))
    closed = units.closed(open_).first()
    assert closed.auto_declared == 3 and [e.name for e in closed.entities] == ["Ana", "boris", "ghost", "old man"]
    assert closed.entities[-1].attributes == {"declared_by": "reference_closure"} and closed.entities[-1].relationships == []
    assert closed.extraction_warnings == ["auto-declared 3 entity id(s) referenced but not defined: boris, ghost, old_man"]
    whole = frame(spark, unit())
    assert units.closed(whole).drop("auto_declared").collect() == whole.collect()
    # closure and its check look at the same places
    for changed, want in ((open_, "fail"), (units.closed(open_).drop("auto_declared"), "warn"), (whole, "pass")):
        got = checks.references(units.used_ids(changed), units.declared_ids(changed)).first()
        assert got.status == want
    assert [v.split() for v in checks.references(units.used_ids(open_), units.declared_ids(open_)).first().violations] == [["sc-1", "beats[1].state_changes.entity", "ghost"], ["sc-1", "present", "old_man"], ["sc-1", "referenced", "boris"], ["sc-1", "relationships.target_id", "old_man"]]
    # an id declared by another unit is declared
    other = frame(spark, unit(referenced=["zoe"]), unit("sc-2", 1, entities=[entity("zoe"), entity("ana")]))
    assert checks.references(units.used_ids(other), units.declared_ids(other)).first().status == "pass"


def test_ids_are_renamed_wherever_they_stand(spark):
    change = {"entity": "anna", "field": "anna", "from": "anna", "to": "x"}
    u = unit(present=["anna"], beats=[beat(1, "anna", actor="anna", addressee="anna", state_changes=[change])], entities=[entity("anna", relationships=[{"predicate": "is", "target": "anna", "target_id": "anna"}]), entity("boris")])
    merges = spark.createDataFrame([("d", "anna", "ana")], "doc_id string, alias string, canonical string")
    got = units.renamed(frame(spark, u).withColumn("doc_id", F.lit("d")), merges)
    assert {r.entity_id for r in units.used_ids(got).collect()} == {"ana", "boris"} and {r.entity_id for r in units.declared_ids(got).collect()} == {"ana", "boris"}
    assert {r.text for r in units.text_fields(got).collect()} >= {"anna"}


def test_patches_and_roll_up(spark):
    df = frame(spark, unit(), unit("sc-2", 1, present=["anna"], entities=[entity("anna")]))
    merges = spark.createDataFrame([("d", "anna", "ana"), ("e", "ana", "zoe")], "doc_id string, alias string, canonical string")
    merged = units.renamed(df.withColumn("doc_id", F.lit("d")), merges)
    rolled = {r.entity_id: r for r in units.roll_up(merged).collect()}
    assert rolled["ana"].name == "Ana" and rolled["ana"].aliases == ["A.", "Anna"] and rolled["ana"].scenes == 2
    fixed = units.patched(df, spark.createDataFrame([("sc-1", 2, "old fix", 0), ("sc-1", 2, "new fix", 1), ("sc-1", 9, "nowhere", 2)], "scene_id string, `order` int, content string, ord int"))
    assert [b.content for b in fixed.where("scene_id = 'sc-1'").first().beats] == ["something happens 1", "new fix", "something happens 3"]


def test_scene_maps(spark):
    source = "Once there was a quay. Ana came.  Boris left at dawn."
    rows = [("a", 0, 22, "Once there was", "a quay."), ("b", 23, 53, "Ana came. Boris", "at dawn.")]
    schema = "scene_id string, start_char int, end_char int, start_quote string, end_quote string"
    check = lambda r: {(e.scene_id, e.error) for e in units.map_errors(spark.createDataFrame(r, schema).withColumn("doc_id", F.lit(1)), F.lit(source), F.lit(len(source))).collect()}
    assert check(rows) == set()
    assert ("b", "out of bounds") in check([rows[0], ("b", 23, 99, *rows[1][3:])])
    assert ("a", "start differs") in check([("a", 1, 22, *rows[0][3:])]) and ("b", "overlap") in check([("a", 0, 30, *rows[0][3:]), rows[1]])
    assert ("b", "end differs") in check([rows[0], (*rows[1][:4], "at noon")])
    r = units.attribution(spark.createDataFrame(rows, schema).withColumn("doc_id", F.lit(1)), F.lit(len(source))).first()
    assert (r.covered, r.gaps) == (52, 1)


def test_objects(spark):
    o = units.numbered(spark.createDataFrame([(3, 0), (3, 1), (4, 0)], "window int, ord int"))
    assert sorted(r.ao_id for r in o.collect()) == ["ao-w003-000", "ao-w003-001", "ao-w004-000"]
    g = units.merge_groups(spark.createDataFrame([(0, i) for i in range(5)], "level int, `group` int"))
    assert sorted((r.group, r.parent) for r in g.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    arcs = spark.createDataFrame([("x", ["ao-w003-001", "no", "ao-w003-000"]), ("y", ["no", "ao-w003-000"])], "name string, stages array<string>")
    assert [(r.name, r.stages) for r in units.arc_stages(arcs, o).collect()] == [("x", ["ao-w003-001", "ao-w003-000"])]
    assert units.seams(spark.createDataFrame([(7, 1), (7, 2), (7, 5), (8, 1)], "doc_id int, window int")).count() == 2


def test_samples(spark):
    want = list(range(9))
    random.Random(250219413).shuffle(want)
    assert sampling.shuffled_order(9) == want
    q = spark.createDataFrame([("q1", ["w", "x", "y", "z"], 2)], "question_id string, options array<string>, correct_index int")
    for r in sampling.shuffled_options(q, 6).collect():
        assert sorted(r.shown) == ["w", "x", "y", "z"] and r.shown[r.correct_position] == "y"
    text = " ".join(map(str, range(10)))
    groups = [text.split()[i : i + 3] for i in range(0, 10, 3)]
    random.Random(5).shuffle(groups)
    assert spark.createDataFrame([(text,)], "t string").select(sampling.groups_scrambled(3, 5)("t")).first()[0] == " ".join(w for g in groups for w in g)
    r = sampling.paired_test(spark.createDataFrame([("v", f"q{i}", 1.0 if i % 3 else -0.5) for i in range(30)], "v string, question_id string, difference double"), "v", resamples=500).first()
    assert r.low <= r.mean <= r.high and r.p < 0.1
