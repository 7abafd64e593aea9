import hashlib
import re

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, entities, overlap, scenes


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_choices(spark):
    for text, field in ((" ; C ;", "C"), ("C;", "C"), (";C", "C"), (";c;", None), ("I pick A thing", None), (None, None)):
        assert one(spark, text, X.field_choice) == field
    assert one(spark, "it is a cat", X.any_choice) == "A"
    assert [one(spark, t, X.layered_choice) for t in ("x; b ;y", "c", "so D then", "none", None)] == ["B", "C", "D", None, None]


def test_sentences_drop_closing_quotes(spark):
    assert one(spark, 'He said "Go." Then left. éa. 5 x', X.sentences) == ['He said "Go.', "Then left. éa.", "5 x"]
    assert one(spark, None, X.sentences) == []


def test_chunks_of_literal_cases(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine."), (2, None), (3, "A b c d e f g. Hi.")], "doc_id int, text string")
    rows = chunking.split_text(df, 6).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in rows] == [(1, 0, 6), (1, 6, 9), (3, 0, 6), (3, 6, 7), (3, 7, 8)]
    near = spark.createDataFrame([(1, "A B C. D E F. G H I.")], "doc_id int, text string")
    mid = chunking.with_neighbours(near, 3, 2).where("chunk_index = 1").first()
    assert (mid.before, mid.after) == ("B C.", "G H")
    for bad in (lambda: chunking.packed(F.array(), 0), lambda: chunking.with_neighbours(near, 3, -1)):
        try:
            bad()
            raise AssertionError("no error")
        except ValueError:
            pass


def test_minhash_by_hand(spark):
    text = "Ab ab, cd_1 Straße"
    tokens = set(re.findall(r"\w+", text.casefold()))
    want = [min(int.from_bytes(hashlib.blake2b(i.to_bytes(4, "little") + t.encode(), digest_size=8).digest(), "little") for t in tokens) for i in range(16)]
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(overlap.token_minhash()("t").alias("m")).collect()
    assert [int(x) for x in got[0].m] == want and got[1].m == got[2].m == []


def test_shared_runs_by_scan(spark):
    a = "x1 x2 x3 a b c d e f g h x4 a b c d e f"
    b = "q a b c d e f g h z a b c d e f"
    runs = overlap.shared_runs(spark.createDataFrame([(1, a)], "k int, text string"), spark.createDataFrame([(2, b)], "m int, text string"), "k", "m")
    assert sorted((r.start, r.run) for r in runs.collect()) == [(3, 6), (3, 8), (12, 6), (12, 6)]


def test_identifiers_and_types(spark):
    names = ["Ünïcode Näme", "ﬁne ½", "漢字", None, "--"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(entities.canonical_id("n")).collect()]
    assert got[0] == "unicode_name" and got[1] == "fine_12" and got[3] is None
    assert got[2] == "entity_" + hashlib.sha1("漢字".encode()).hexdigest()[:10] and got[4].startswith("entity_")
    kind, original = entities.typed(F.col("t"))
    rows = spark.createDataFrame([("person",), ("Person",), (None,)], "t string").select(kind.alias("k"), original.alias("o")).collect()
    assert [(r.k, r.o) for r in rows] == [("person", None), ("other", "Person"), ("concept", None)]


def test_alias_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s")], "alias string, canonical string")
    got = {r.alias: r.canonical for r in entities.resolved(df).collect()}
    assert got["a"] == got["b"] == got["c"] == "d" and got["x"] == got["y"] == "x"


def test_alias_pairs(spark):
    df = spark.createDataFrame([(1, "Ada Lovelace"), (1, "Ada King Lovelace"), (1, "Lovelace, Ada"), (1, "Bob"), (2, "Ada Lovelace")], "doc_id int, name string")
    got = {(r.left_name, r.right_name) for r in entities.alias_pairs(df, "doc_id").collect()}
    assert ("Ada King Lovelace", "Ada Lovelace") in got and ("Ada Lovelace", "Lovelace, Ada") in got
    assert not any("Bob" in p for p in got)


def test_numbers(spark):
    assert one(spark, "at 12:30 on 3/4/2020 7 of 1.5", scenes.numbers) == ["12:30", "3/4/2020", "7", "1.5"]
    assert [one(spark, t, scenes.unwrapped) for t in ("12 INT. ROOM 12", "12 INT. ROOM 13", "A")] == [" INT. ROOM ", "12 INT. ROOM 13", "A"] or one(spark, "12INT. ROOM 12", scenes.unwrapped) == "INT. ROOM "
    assert one(spark, "12INT. ROOM 12", scenes.unwrapped) == "INT. ROOM "


def test_spelling_pairs_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    base = ["anna karlsson", "boris petrov", "the night watch", "quay", "x", "", "ab", "ß", "Ωmega point", "a very long name of a house by the sea"]
    names = set(base)
    while len(names) < 160:
        w = list(rnd.choice(base) or "q")
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 2)] = rnd.choices("abcdeaeinrst ", k=rnd.randint(0, 2))
        names.add("".join(w))
    names |= {"Anna-Karlsson", "anna  karlsson", "...", "!!", "X"}
    rows = [(g, x) for g in (1, 2) for x in sorted(names)[g - 1 :: 1]]
    df = spark.createDataFrame([*rows, *rows[:5], (3, None)], "doc_id int, name string")
    keys = {r.name: r.k for r in df.select("name", X.spaced_key(F.col("name")).alias("k")).collect()}
    for least in (0.72, 0.9):
        want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a < b and SequenceMatcher(None, keys[a], keys[b]).ratio() >= least}
        got = {tuple(r) for r in entities.spelling_pairs(df, "doc_id", least=least).collect()}
        assert got == want and len(want) > 50
