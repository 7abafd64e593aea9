"""A clean fixture passes every check; each corruption fails the one that it is made for."""

import pytest

from corpusloom.operators import checks, units

from .records import beat, frame, unit

SOURCE = [("sc-1", "Ana hurries along the quay. The manifest says Container 47 never reached Pier 9 on the 14th of May. Boris shrugs and lights a cigarette.")]
FIELDS = [("sc-1.beats[1].content", "A dock worker is told that one box went missing before it could be unloaded."), ("sc-1.style", "terse and cold")]
BEATS = [("sc-1", 1, []), ("sc-1", 2, [1]), ("sc-1", 3, [1, 2])]
OBJECTS = [("ao-1", "motive", "sc-1", "Ana fears that the loss was arranged by a friend", ["sc-1#1"], "she hides her worry", "probable", "he proves innocent"), ("ao-2", "theory_of_mind", "sc-1", "Boris assumes nobody will check the papers", ["sc-1#2", "sc-1#3"], "he relaxes", "possible", "he panics")]
CONTENT = [("sc-1#1", "The box is declared lost"), ("sc-1#2", "A man shrugs"), ("sc-1#3", "He smokes")]


class Make:
    def __init__(self, spark):
        self.spark = spark

    def __call__(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def objects(self, rows=OBJECTS):
        return self(rows, "ao_id string, type string, scene_id string, statement string, grounded_in array<string>, reasoning string, confidence string, falsifier string")

    def beats(self, rows=CONTENT):
        return self(rows, "ref string, content string")


@pytest.fixture(scope="module")
def make(spark):
    return Make(spark)


def status(df):
    return df.first().status


@pytest.mark.parametrize("units,want", [(["sc-1"], "pass"), ([], "fail"), (["sc-1", "sc-1"], "fail"), (["sc-1", "sc-999"], "fail")])
def test_c1(make, units, want):
    assert status(checks.coverage(make([(u,) for u in units], "scene_id string"), make([("sc-1",)], "scene_id string"))) == want


@pytest.mark.parametrize(
    "text,fail_at,want",
    [(None, 8, "pass"), ("They said Container 47 never reached Pier 9 on the 14th and that was that.", 8, "fail"), ("'Boris shrugs and lights a cigarette' it says", 6, "fail"), ("He mentions that never reached pier 9 on the", 8, "warn")],
)
def test_c2(make, text, fail_at, want):
    fields = FIELDS if text is None else [*FIELDS, ("sc-1.x", text)]
    assert status(checks.verbatim(make(fields, "path string, text string"), make(SOURCE, "scene_id string, text string"), fail_at=fail_at)) == want


@pytest.mark.parametrize("stated,want", [(["47", "9", "14"], "pass"), (["48", "9", "14"], "fail"), (["9", "14"], "warn"), (["470", "9", "14", "47"], "pass")])
def test_c3(make, stated, want):
    source = make([("sc-1", n) for n in ("47", "9", "14")], "scene_id string, number string")
    assert status(checks.numbers_kept(make([("sc-1", n) for n in stated], "scene_id string, number string"), source)) == want


@pytest.mark.parametrize("beats,want", [(BEATS, "pass"), ([("sc-1", 1, []), ("sc-1", 2, []), ("sc-1", 2, [])], "fail"), ([("sc-1", 1, []), ("sc-1", 2, []), ("sc-1", 4, [])], "fail"), ([("sc-1", 1, [3]), *BEATS[1:]], "fail")])
def test_c4(make, beats, want):
    assert status(checks.beat_order(make(beats, "scene_id string, `order` int, causes array<int>"))) == want


@pytest.mark.parametrize("used,auto,want", [(["ana"], False, "pass"), (["ana", "zoe"], False, "fail"), (["ana"], True, "warn")])
def test_c5(make, used, auto, want):
    declared = make([("sc-1", "ana", auto)], "scene_id string, entity_id string, auto boolean")
    assert status(checks.references(make([("sc-1", "present", u) for u in used], "scene_id string, path string, entity_id string"), declared)) == want


@pytest.mark.parametrize("values,want", [([f"word{i} other{i} thing{i}" for i in range(12)], "pass"), (["same old style"] * 30, "fail"), (["one two three four five", "one two three four six"] * 2, "fail")])
def test_c6(make, values, want):
    assert status(checks.variety(make([("style", i, v) for i, v in enumerate(values)], "field string, ord int, value string"))) == want


@pytest.mark.parametrize("emitted,want", [(0, "pass"), (1, "fail"), (-1, "fail"), (None, "unverified")])
def test_c7(spark, emitted, want):
    assert status(checks.canary(spark, emitted)) == want


@pytest.mark.parametrize("cited,want", [(["sc-1#1"], "pass"), ([], "fail"), (["sc-1#99"], "fail"), (["sc-777#1"], "fail")])
def test_g1(make, cited, want):
    assert status(checks.grounding(make.objects([(*OBJECTS[0][:4], cited, *OBJECTS[0][5:])]), make.beats())) == want


def test_g2(make):
    assert status(checks.restatement(make.objects(), make.beats())) == "pass"
    copy = [(*OBJECTS[0][:3], "The box is declared lost now", *OBJECTS[0][4:])]
    assert status(checks.restatement(make.objects(copy), make.beats())) == "fail"


def test_g3(make):
    assert status(checks.confidence(make.objects())) == "pass"
    many = [(f"ao-{i}", *OBJECTS[0][1:]) for i in range(10)]
    assert status(checks.confidence(make.objects(many))) == "fail"
    certain = checks.confidence(make.objects([OBJECTS[0], (*OBJECTS[1][:6], "near-certain", OBJECTS[1][7])])).first()
    assert certain.status == "pass" and certain.violations == ["ao-2"]


@pytest.mark.parametrize("stances,want", [(["supports"] * 5 + ["contradicts"], "pass"), (["supports"] * 6, "warn"), ([], "fail")])
def test_g4(make, stances, want):
    assert status(checks.contradiction(make([("ao-1", s) for s in stances], "ao_id string, stance string"))) == want


def test_g5(make):
    links = lambda rows: make(rows, "from_ao string, to_ao string")
    assert status(checks.linked(make.objects(), links([("ao-1", "ao-2")]))) == "pass"
    assert status(checks.linked(make.objects([(f"ao-{i}", *OBJECTS[0][1:]) for i in range(10)]), links([]))) == "fail"
    dangling = checks.linked(make.objects(), links([("ao-1", "ao-9")])).first()
    assert dangling.detail["n_violations"] == 1


def test_g6_g7_g8(make):
    scenes = lambda *s: make([(x,) for x in s], "scene_id string")
    assert status(checks.spread(make.objects(), scenes("sc-1"))) == "pass"
    assert status(checks.spread(make.objects(), scenes("sc-1", "sc-2"))) == "fail"
    assert status(checks.minds(make.objects())) == "pass" and status(checks.minds(make.objects(OBJECTS[:1]))) == "warn"
    source = make(SOURCE, "scene_id string, text string")
    assert status(checks.graph_verbatim(make.objects(), source)) == "pass"
    for at in (3, 5):
        bad = list(OBJECTS[0])
        bad[at] = "container 47 never reached pier 9 on the 14th of may"
        assert status(checks.graph_verbatim(make.objects([tuple(bad)]), source)) == "fail"


def test_gate(spark, make):
    every = [checks.coverage(make([("sc-1",)], "scene_id string"), make([("sc-1",)], "scene_id string")), checks.minds(make.objects())]
    assert {r.status for r in checks.gated(every, []).collect()} == {"unverified"}
    assert {r.status for r in checks.gated(every, ["C1", "G7"]).collect()} == {"pass"}
    assert checks.gate_passed(checks.gated(every, ["C1"]))
    assert not checks.gate_passed(checks.gated([*every, checks.canary(spark, 1)], ["C1"]))


# ---------------------------------------------------------------- copied runs by scope
QUAY = "EXT. QUAY\nAna counts the crates and frowns. Container 47 never reached Pier 9 on the 14th, she says.\nBoris shrugs. 'I moved it because they were watching me.' She takes his keycard and goes."
LATER = "INT. OFFICE\nA clerk stamps each paper twice without looking up from the desk."


def matched(spark, said, scenes=(("sc-1", QUAY), ("sc-2", LATER)), **more):
    u = frame(spark, unit(context_before="", context_after="", style="", beats=[beat(i, s, facts=more.get("facts")) for i, s in enumerate(said, 1)], entities=[]))
    scene = spark.createDataFrame([(s, "d", t, ["ANA", "BORIS"], "QUAY", "EXT. QUAY") for s, t in scenes], "scene_id string, doc string, text string, speakers array<string>, location string, heading string")
    docs = spark.createDataFrame([("d", "\n".join(t or "" for _, t in scenes)), ("other", "nothing of this stands anywhere else in the world")], "doc string, text string")
    known = checks.known_tokens(u, scene)
    found = checks.scene_matches(units.placed_fields(u).join(scene.select("scene_id", "doc"), "scene_id"), scene, docs, known)
    return found, checks.scoped_verbatim(found, known, more.get("fail_at", 8)).first()


@pytest.mark.parametrize(
    "said,fail_at,want",
    [
        (["Ana learns that one box is lost"], 8, "pass"),
        (["Ana said Container 47 never reached Pier 9 on the 14th and that was that."], 8, "fail"),
        (["She takes his keycard and goes, which is how it ends."], 6, "fail"),
        (["Boris was recorded saying 'I moved it because they were watching me' that night."], 8, "fail"),
        (["he told that a clerk stamps each paper twice without looking"], 8, "fail"),
        (["she takes his keycard and goes away"], 8, "warn"),
    ],
)
def test_scoped_c2(spark, said, fail_at, want):
    assert matched(spark, said, fail_at=fail_at)[1].status == want


def test_matches_prefer_length_then_place_then_the_own_scene(spark):
    found, row = matched(spark, ["a clerk stamps each paper twice. she takes his keycard and goes", "her keycard and goes int office a clerk stamps each", "nothing like it"])
    got = {r.path: (r.run, r.start, r.scope, " ".join(r.gram)) for r in found.collect()}
    assert got["beats[1].content"] == (6, 0, "document", "a clerk stamps each paper twice")
    # a run over two scenes is in the document only, and is the longer one
    assert got["beats[2].content"] == (9, 1, "document", "keycard and goes int office a clerk stamps each")
    assert len(got) == 2 and row.detail["longest"] == 9 and [v.split()[2] for v in row.violations] == ["9/7", "6/5"]
    own = {r.path: r.scope for r in matched(spark, ["she takes his keycard and goes"])[0].collect()}
    assert own == {"beats[1].content": "scene"}


def test_facts_alone_are_dismissed(spark):
    facts = {"quantities": ["Container 47", "Pier 9"], "dates": ["on the 14th"], "proper_nouns": ["never reached"], "locations": []}
    found, row = matched(spark, ["it says Container 47 never reached Pier 9 on the 14th indeed"], facts=facts)
    assert row.status == "pass" and row.detail["longest"] == 9 and row.detail["longest_adjudicated"] == 0 and row.detail["dismissed"] == 1
    assert checks.match_lengths(found).collect() == []


def test_long_and_hot_runs(spark):
    words = [f"w{i}" for i in range(60)]
    found, _ = matched(spark, [" ".join(words[5:50]), "und " * 300], scenes=(("sc-1", " ".join(words)), ("sc-2", "und " * 3000), ("sc-3", None)))
    assert {(r.run, r.start, r.scope) for r in found.collect()} == {(25, 0, "scene"), (25, 0, "document")}
