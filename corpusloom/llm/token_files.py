"""Token ids of whole texts in binary files, packed by Re-Pair grammars, with random access.

Texts are cut where the tokenizer cuts them before its merges, so that only distinct words of a batch go through the
library. Documents in ascending key order are dealt to files of about FILE_IDS ids. A file is a sequence of blocks of at
most BLOCK_IDS ids; each block has a grammar of its own: rounds of counting pairs of neighbouring symbols and replacing the
frequent ones by nonterminals, until hardly anything is gained. Pairs never span two documents.

A file, all numbers little-endian::

    "RPG1", uint32 documents, uint32 blocks, uint8 width, 3 zero bytes, uint64 ids, uint32 first nonterminal
    documents x (uint32 length of the key, all ones for none, uint64 first id of the document), the keys one after another in UTF-8
    blocks x (uint64 first id, uint32 rules, uint32 symbols, uint64 where its bytes begin)
    each block: rules x 2 symbols, rules x uint32 expansion length, symbols; width bytes a symbol
    uint32 crc32 of all before
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, dictionary, give_back, materialize, run_lengths

BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 21
SEGMENT = 3 << 20
REMEMBERED = 1 << 19
SLOT_BITS = 20
MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIB3xQI")
#: a pair is replaced if it stands in a block at least so often; rounds end when one saves less than this share of the symbols
LEAST_PAIRS = 16
LEAST_GAIN = 0.03
NO_KEY = (1 << 32) - 1
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: byte-level vocabularies spell a byte that doesn't print by the next free character from 256 on
_PLAIN = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
BYTE_NAMES = np.where(_PLAIN, np.arange(256), 255 + np.cumsum(~_PLAIN)).astype("<u4")
#: where a text may be cut without splitting a word: before a space between two that aren't white space
SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    """Where the public tokenizers' byte-level file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- encoding
class Encoder:
    """Ids of many texts at once by a byte-level tokenizer whose pre-tokenizer is the usual pattern of such files."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        # the same merges for words that are cut and spelt in bytes already
        self.merges = Tokenizer(self.own.model)
        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        # the first words met, up to REMEMBERED; any other is encoded again in each batch that has it
        self.known: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]

    def _learn(self, points: np.ndarray) -> None:
        """The kind of each code point, as the tokenizer itself cuts it beside a letter, a digit and a mark."""
        for p in points.tolist():
            whole = lambda a: len(self.own.pre_tokenizer.pre_tokenize_str(a + chr(p) + a)) == 1  # noqa: B023, E731
            self.kinds[p] = LETTER if whole("x") else NUMBER if whole("1") else OTHER if whole("!") else SPACE

    def cuts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where words begin, as a mask over the code points of all texts; ``edges``: where texts begin."""
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.kinds[points]
        n = len(points)
        new = np.zeros(n + 1, dtype=bool)
        new[edges] = True
        new[n] = True
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = kind[1:] == kind[:-1]
        same &= ~new
        begin = ~same[:n]
        # the last of white space before a word: a blank joins the word, anything else stands alone
        space = kind == SPACE
        last = space & ~same[1:] & ~new[1:]
        begin |= last
        joins = np.zeros(n, dtype=bool)
        joins[1:] = last[:-1] & (points[:-1] == 32)
        begin &= ~joins
        # an apostrophe alone, and not after a joined blank, takes s, t, m, d, re, ve or ll with it
        mark = np.flatnonzero((points == 39) & begin & ~same[1:])
        for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
            at = mark[mark + len(tail) < n]
            for j, c in enumerate(tail, 1):
                at = at[(points[at + j] == ord(c)) & ~new[at + j]]
            begin[at + 1] = False
            stop = at + 1 + len(tail)
            stop = stop[stop < n]
            begin[stop[kind[stop] == LETTER]] = True
        return begin

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens of its own."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        batch, size = [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i].append(np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
                continue
            for part in segments(text):
                batch.append((i, part))
                size += len(part)
                if size >= SEGMENT:
                    self._add(batch, out)
                    batch, size = [], 0
        self._add(batch, out)
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of remembered and new words one after another, where each word's begin, and the place of each word asked for."""
        known = self.known
        of = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(of < 0)
        if not len(new):
            return self.ids, self.starts, of
        asked = [words[i] for i in new.tolist()]
        spelt, stops = BYTE_NAMES[np.frombuffer(b"".join(asked), np.uint8)].tobytes().decode("utf-32-le"), [*accumulate(map(len, asked))]
        made = self.merges.encode([spelt[a:b] for a, b in zip([0, *stops], stops)], is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(made.word_ids, dtype=np.int64), np.arange(1, len(asked) + 1))
        before = len(self.starts) - 1
        of[new] = before + np.arange(len(asked))
        ids = np.concatenate([self.ids, np.array(made.ids, dtype=np.uint32)])
        starts = np.concatenate([self.starts, self.starts[-1] + ends])
        room = min(len(asked), REMEMBERED - before)
        if room > 0:
            known.update(zip(asked[:room], range(before, before + room)))
            self.starts = starts[: before + room + 1]
            self.ids = ids[: self.starts[-1]]
        return ids, starts, of

    def _add(self, batch: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        batch = [(i, part) for i, part in batch if part]
        if not batch:
            return
        points = np.frombuffer("".join(part for _, part in batch).encode("utf-32-le"), dtype="<u4")
        lengths = np.array([len(part) for _, part in batch])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        begin = np.flatnonzero(self.cuts(points, edges[:-1]))
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = np.frombuffer("".join(part for _, part in batch).encode(), dtype=np.uint8)
        codes, words = dictionary(data, np.append(at[begin], len(data)))
        ids, starts, of = self._words(words.to_numpy(zero_copy_only=False).tolist())
        flat, ends = gather(ids, starts, of[codes])
        stops = np.concatenate([[0], ends])[np.searchsorted(begin, edges)]
        for (i, _), a, b in zip(batch, stops[:-1], stops[1:]):
            out[i].append(flat[a:b])


def segments(text: str):
    """The text in parts of at least SEGMENT characters, cut only where words are."""
    at = 0
    while len(text) - at > SEGMENT and (cut := SAFE.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def gather(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its run of values, one after another, and where each run ends."""
    n = np.diff(starts)[codes]
    ends = np.cumsum(n)
    if not len(ends):
        return values[:0], ends
    steps = np.ones(int(ends[-1]), dtype=np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return values[:0], ends
    first, before = starts[codes[some]], ends[some] - n[some]
    steps[before] = first
    steps[before[1:]] -= first[:-1] + n[some][:-1] - 1
    return values[np.cumsum(steps)], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- grammars
def slots(keys: np.ndarray) -> np.ndarray:
    """A slot below 2**SLOT_BITS for each pair."""
    if keys.dtype == np.uint32:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).view(np.int32)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def repair(ids: np.ndarray, heads: np.ndarray, first: int, most_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols): symbols from ``first`` on are rules, pairs of earlier symbols with their expansion lengths.

    ``heads`` says where documents begin; no pair spans two. A round counts all pairs of neighbours, takes those that
    stand at least LEAST_PAIRS times, the most frequent first as far as ``most_rules`` go, and replaces them from the
    left. In a run of overlapping finds every second one is replaced.
    """
    bits = 16 if first + most_rules <= 1 << 16 else 32
    kind = np.dtype(np.uint32 if bits == 16 else np.uint64)
    symbols, head = ids.astype(kind), np.zeros(len(ids), dtype=bool)
    head[heads[heads < len(ids)]] = True
    rules, lengths = [], [np.ones(first, dtype=np.int64)]
    have = 0
    while len(symbols) > 1 and have < most_rules:
        keys = symbols[:-1] << kind.type(bits) | symbols[1:]
        # pairs of a rare slot are rare themselves; only the rest is sorted
        slot = slots(keys)
        spots = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= LEAST_PAIRS)[slot] & ~head[1:])
        keys, slot = keys[spots], slot[spots]
        pairs, n = run_lengths(keys)
        pick = np.flatnonzero(n >= LEAST_PAIRS)
        # of two pairs in a slot the more frequent is first, and the other left to the next round
        pick = pick[np.argsort(n[pick], kind="stable")[::-1]]
        pick = pick[np.sort(np.unique(slots(pairs[pick]), return_index=True)[1])][: most_rules - have]
        if not len(pick):
            break
        chosen = np.sort(pairs[pick])
        table = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        table[slots(chosen)] = np.arange(len(chosen))
        place = table[slot]
        found = chosen[place] == keys
        spots, place = spots[found], place[found]
        run = np.concatenate([[True], spots[1:] != spots[:-1] + 1])
        nth = np.arange(len(spots)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        spots, place = spots[nth % 2 == 0], place[nth % 2 == 0]
        # rules that lost all their finds to overlaps are not written
        met = np.bincount(place, minlength=len(chosen)) > 0
        used = chosen[met].astype(np.int64)
        rules.append(np.stack([used >> bits, used & (1 << bits) - 1], axis=1))
        lengths.append(np.concatenate(lengths)[rules[-1]].sum(axis=1))
        before = len(symbols)
        symbols[spots] = (first + have - 1 + np.cumsum(met))[place]
        stay = np.ones(before, dtype=bool)
        stay[spots + 1] = False
        symbols, head = symbols[stay], head[stay]
        have += len(used)
        if before - len(symbols) < LEAST_GAIN * before:
            break
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return made, np.concatenate(lengths)[first:], symbols.astype(np.int64)


def expand(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, first: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    # the rules' own expansions level by level, then one gather for the sequence
    bodies = np.arange(first, first + len(rules))
    while len(bodies) and (deep := bodies >= first).any():
        at = np.cumsum(1 + deep) - 1 - deep
        wider = np.empty(len(bodies) + int(deep.sum()), dtype=np.int64)
        wider[at[~deep]] = bodies[~deep]
        wider[at[deep]], wider[at[deep] + 1] = rules[bodies[deep] - first].T
        bodies = wider
    starts = np.concatenate([np.arange(first), first + np.cumsum(np.append(0, lengths), dtype=np.int64)])
    return gather(np.concatenate([np.arange(first), bodies]), starts, symbols)[0]


def write_file(keys: list[str | None], docs: list[np.ndarray], first: int) -> bytes:
    """The bytes of a file that holds the documents in the order given; ids must be below ``first``."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    width = 2 if first < 1 << 16 else 4
    most = (1 << (8 * width)) - first if width == 2 else 1 << 20
    kind, blocks, bodies, at = f"<u{width}", [], [], 0
    for a in range(0, len(ids), BLOCK_IDS):
        b = min(len(ids), a + BLOCK_IDS)
        rules, lengths, symbols = repair(ids[a:b], starts[(starts >= a) & (starts < b)] - a, first, most)
        body = rules.astype(kind).tobytes() + lengths.astype("<u4").tobytes() + symbols.astype(kind).tobytes()
        blocks.append(struct.pack("<QIIQ", a, len(rules), len(symbols), at))
        bodies.append(body)
        at += len(body)
    names = [None if k is None else k.encode() for k in keys]
    index = np.zeros(len(docs), dtype=[("k", "<u4"), ("at", "<u8")])
    index["k"], index["at"] = [NO_KEY if k is None else len(k) for k in names], starts[:-1]
    whole = b"".join([HEAD.pack(MAGIC, len(docs), len(blocks), width, len(ids), first), index.tobytes(), *filter(None, names), *blocks, *bodies])
    return whole + struct.pack("<I", zlib.crc32(whole))


class TokenFile:
    """Reads the bytes of a file; raises ValueError where they are damaged."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole token file")
        self.data = data
        _, n, blocks, self.width, self.ids, self.first = HEAD.unpack_from(data)
        index = np.frombuffer(data, [("k", "<u4"), ("at", "<u8")], n, HEAD.size)
        self.starts = np.append(index["at"], self.ids).astype(np.int64)
        at = HEAD.size + index.nbytes
        none = index["k"] == NO_KEY
        ends = at + np.concatenate([[0], np.cumsum(np.where(none, 0, index["k"]), dtype=np.int64)])
        self.keys = [None if x else data[a:b].decode() for x, a, b in zip(none, ends[:-1].tolist(), ends[1:].tolist())]
        self.blocks = np.frombuffer(data, [("at", "<u8"), ("rules", "<u4"), ("symbols", "<u4"), ("byte", "<u8")], blocks, int(ends[-1]))
        self.body = int(ends[-1]) + self.blocks.nbytes

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.blocks[i]
        at, rules, kind = self.body + int(b["byte"]), int(b["rules"]), f"<u{self.width}"
        pairs = np.frombuffer(self.data, kind, 2 * rules, at).reshape(rules, 2).astype(np.int64)
        lengths = np.frombuffer(self.data, "<u4", rules, at + 2 * rules * self.width)
        return pairs, lengths, np.frombuffer(self.data, kind, int(b["symbols"]), at + rules * (2 * self.width + 4)).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of places ``start`` to ``stop`` of the file; only symbols that touch them are expanded."""
        start, stop, out = max(0, start), min(stop, self.ids), []
        begins = self.blocks["at"].astype(np.int64)
        for i in range(max(0, int(np.searchsorted(begins, start, side="right")) - 1), len(begins)):
            if begins[i] >= stop:
                break
            rules, lengths, symbols = self.block(i)
            size = np.where(symbols >= self.first, lengths[np.maximum(symbols - self.first, 0)] if len(lengths) else 1, 1)
            ends = begins[i] + np.cumsum(size, dtype=np.int64)
            a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
            skipped = int(ends[a] - size[a]) if a < len(ends) else 0
            ids = expand(rules, lengths, symbols[a:b], self.first)
            out.append(ids[max(0, start - skipped) : stop - skipped])
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


# ---------------------------------------------------------------- tables of files
def token_files(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(start, n_ids, data): the files of all documents in ascending ``key`` order, written to the shared folder.

    ``data`` is a file of this format and ``start`` the number of ids in all files before it. A row of the table is a file
    and not a name in a local folder, so that Spark's own commit makes it whole or absent and any store will do. Null
    keys come first; equal keys are ordered by their texts' hashes. A null text counts as empty: its document holds the
    end id alone. A document is never split over files; one of more than FILE_IDS ids has a file to itself, and its
    task holds about ten bytes a character. Other columns are left out. ``path`` names the tokenizer on each executor.
    """
    named = path

    def run(source):
        own = encoder(named or default_tokenizer())
        first = max(own.own.get_vocab_size(), end_id + 1)
        kind = np.uint16 if first <= 1 << 16 else np.uint32
        part, before, size = TaskContext.get().partitionId(), 0, 0
        keys, docs = [], []
        for batch in batches(source, SEGMENT):
            keys += batch.column("key").to_pylist()
            for ids in own.encode([x or "" for x in batch.column("text").to_pylist()]):
                docs.append(np.append(ids, np.uint32(end_id)).astype(kind))
                size += len(docs[-1])
                if size >= FILE_IDS:
                    yield row(part, before, size, keys[: len(docs)], docs, first)
                    keys, docs, before, size = keys[len(docs) :], [], before + size, 0
        if docs:
            yield row(part, before, size, keys, docs, first)
        give_back()

    def row(part, before, size, keys, docs, first):
        data = pa.array([write_file(keys, docs, first)], pa.large_binary())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before]), pa.array([size]), data.cast(pa.binary())], names=["part", "before", "n_ids", "data"])

    order = [F.col("_order").asc_nulls_first(), F.col("_same"), F.col("_tie")]
    rows = documents.select(F.col(key).alias("_order"), F.xxhash64(text).alias("_same"), F.monotonically_increasing_id().alias("_tie"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    stored = materialize(ranged.mapInArrow(run, "part int, before long, n_ids long, data binary"), "token-files")
    bases, done = [], 0
    for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r.part, done))
        done += r.n
    base = F.broadcast(documents.sparkSession.createDataFrame(bases, "part int, base long"))
    files = stored.join(base, "part").select((F.col("base") + F.col("before")).alias("start"), "n_ids", "data")
    files._stored_at = stored._stored_at
    return files


def documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files: the key as text, the ids of all documents before,
    the document's own, and the crc32 of these as unsigned 32-bit integers, low byte first. Damaged files raise."""

    def run(source):
        for batch in source:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                held = TokenFile(data.as_py())
                ids = held.read(0, held.ids).astype("<u4")
                edges = held.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(held.keys, pa.string()), pa.array(start + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    return files.select("start", "data").mapInArrow(run, "doc_id string, start long, n_tokens long, ids_crc32 long")


def token_digests(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every row of ``documents``, after writing its files and reading them back."""
    files = token_files(documents, path, key, text, end_id)
    found = documents_of(files)
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema[key].dataType))
