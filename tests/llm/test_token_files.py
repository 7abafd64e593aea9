import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import token_files as K

from .conftest import prose

PATH = K.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(texts, library):
    got = K.encoder(PATH).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for t, a, b in zip(texts, got, want):
        assert a.tolist() == b, repr(t[:80])


def test_ids_are_the_library_s(library):
    texts = ["", " ", "  ", "a", "it's we'll I'd they've 's 't '' ''s '\"s x'sabc y'Sab 'll'ree", " 's\n's \n's", "tab\tx \t y  z", "é𝛼ß ▁ ½ ² ٣ x٣y", "a b 　c d", "line\r\n\r\n  next   ", "\x00\x1c\x1fz\x85q",
             "'", "a'", "'s", "don'", "don't'", "1's2", "﻿x", "é ́", "<|endoftext|>", "x<|endoftext|> y", "'re've'm'l'll'lld", "s't"]
    same(texts, library)
    rnd = random.Random(3)
    alphabet = "ab '’1 2\n\t!s t.re l é½中́x'"
    same(["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(3000)], library)


def test_whole_documents_and_long_ones(library, monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    same(texts, library)
    monkeypatch.setattr(K, "SEGMENT", 100)
    same(texts[:50] + [" ".join(texts)[:50_000], "x" * 1000, " " * 1000, "ab\n " * 400], library)


def sequence(seed, n):
    rnd = random.Random(seed)
    parts = [[rnd.randrange(50257) for _ in range(rnd.randint(1, 9))] for _ in range(40)]
    return np.array([x for _ in range(n) for x in rnd.choice(parts)], dtype=np.uint32)


@pytest.mark.parametrize("ids", [sequence(1, 3000), np.zeros(5000, np.uint32), np.array([7], np.uint32), np.zeros(0, np.uint32), np.arange(3000, dtype=np.uint32), np.array([1, 2] * 4000, np.uint32)])
def test_grammars_give_their_text_back(ids):
    rules, lengths, symbols = K.repair(ids, np.array([0]), 50257, 15_000)
    assert K.expand(rules, lengths, symbols, 50257).tolist() == ids.tolist()
    # each rule's length is that of its expansion, and a rule names earlier symbols only
    for i in range(0, len(rules), 7):
        assert len(K.expand(rules, lengths, np.array([50257 + i]), 50257)) == lengths[i] and rules[i].max() < 50257 + i
    if len(ids) > 4000:
        assert len(symbols) < len(ids) / 3


def test_no_pair_spans_documents():
    rules, _, symbols = K.repair(np.array([1, 2] * 500, np.uint32), np.arange(1, 1000), 50257, 15_000)
    assert len(rules) == 0 and len(symbols) == 1000


@pytest.mark.parametrize("block", [50, 1000, 1 << 20])
@pytest.mark.parametrize("first", [50_257, 70_000])
def test_random_access(monkeypatch, block, first):
    monkeypatch.setattr(K, "BLOCK_IDS", block)
    docs = [sequence(i, 5 * i) for i in range(30)]
    held = K.TokenFile(K.write_file([None, *(f"ключ{i}" for i in range(29))], docs, first))
    whole = np.concatenate(docs)
    assert held.keys[:3] == [None, "ключ0", "ключ1"] and held.ids == len(whole)
    for i in (0, 1, 17, 29):
        assert held.document(i).tolist() == docs[i].tolist()
    rnd = random.Random(block)
    for _ in range(60):
        a = rnd.randrange(len(whole))
        b = min(len(whole), a + rnd.randrange(300))
        assert held.read(a, b).tolist() == whole[a:b].tolist()
    assert held.read(0, len(whole) + 9).tolist() == whole.tolist()


def test_damage_is_found():
    data = K.write_file(["a"], [sequence(1, 50)], 50_257)
    for bad in (data[:-1], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"", b"RPG1"):
        with pytest.raises(ValueError):
            K.TokenFile(bad)


def test_contract_against_the_library(spark, odd, library, monkeypatch):
    docs = odd.unionByName(spark.createDataFrame([(3000 - i, prose(200, i)) for i in range(100)], "doc_id long, text string"), allowMissingColumns=True).withColumn("start", F.lit(3))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = K.token_digests(docs).collect()
    want = {}
    for key, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k[0], k[1] or 0))


def test_empty_table(spark, none_at_all):
    assert K.token_digests(none_at_all).collect() == []


def test_few_words_remembered(library, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 7)
    own = K.Encoder(PATH)
    texts = [prose(50, i) + f" odd{i}" for i in range(20)]
    for _ in range(2):
        for t in texts:
            assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(own.known) == 7
