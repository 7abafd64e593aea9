"""Phrases whose words stand together more often than apart, from suffix automata of bounded depth.

Texts are dealt to shards. The pieces of a shard make one generalised suffix automaton of the substrings of up to
``depth`` words, with the number of their end positions and suffix links; it is built level by level by sorting, which gives
the states of an online construction to that depth in array form. Two passes reduce the shards' counts:

1. each shard sends 32-bit hashes of its substrings, dealt to ranges of hashes, with counts as far as they matter; a range
   adds them up and marks the hashes that reach the least count in a filter of fixed size;
2. each shard sends the substrings that the filter lets through, with their counts; added up by their words they are
   exact, and what the filter let through in vain is left out.

A phrase and its longer neighbours are tied by suffix links (the phrase without its first word) and by transitions (without
its last): what a longer phrase nearly always covers is dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, batches, dictionary, give_back, hash_spans, join_unique, materialize, scratch, splitmix, utf8_view, word_spans

DEPTH = 3
LEAST = 10
COVERED = 50
TOP = 2000
SHARD_WORDS = 1 << 19
#: bytes of text for each range of hashes; the filter's bits
RANGE_BYTES = 4 << 20
FILTER_BITS = 27
SPREAD = 64

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 32]] = True
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True


# ---------------------------------------------------------------- automata
@dataclass
class Level:
    """Substrings of one length: where the transition to each comes from and its word, its suffix link, its end positions."""

    source: np.ndarray
    label: np.ndarray
    link: np.ndarray
    count: np.ndarray


@dataclass
class Automaton:
    """Generalised suffix automaton of the substrings of up to ``depth`` words of all pieces.

    ``words`` are numbers below ``size``, ``head`` says where pieces begin. ``levels[i]`` holds the substrings of i + 1 words;
    links and sources are places in the level before (in the first they are -1).
    """

    words: np.ndarray
    head: np.ndarray
    size: int
    depth: int = DEPTH
    levels: list[Level] = field(default_factory=list)

    def __post_init__(self):
        words, none = self.words.astype(np.int32), np.full(self.size, -1, dtype=np.int32)
        self.levels = [Level(none, np.arange(self.size, dtype=np.int32), none, np.bincount(words, minlength=self.size).astype(np.int32))]
        # node[i]: the substring of this level that ends at ends[i]; a piece's first words end no longer ones
        node, ends = words, np.arange(len(words), dtype=np.int32)
        for _ in range(1, self.depth):
            where = np.flatnonzero((ends[1:] == ends[:-1] + 1) & ~self.head[ends[1:]]).astype(np.int32) + 1
            ends = ends[where]
            key = node[where - 1].astype(np.int64) * self.size + words[ends]
            order = np.argsort(key)
            key = key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            heads = np.flatnonzero(first)
            source, label = np.divmod(key[heads], max(1, self.size))
            counts = np.diff(np.append(heads, len(key)))
            self.levels.append(Level(*(x.astype(np.int32) for x in (source, label, node[where[order[heads]]], counts))))
            node = np.empty(len(key), dtype=np.int32)
            node[order] = np.cumsum(first, dtype=np.int32) - 1

    def absorbed(self, level: int) -> np.ndarray:
        """Which substrings of a level end where a longer one always does: they share its state."""
        out = np.zeros(len(self.levels[level].count), dtype=bool)
        if level + 1 < len(self.levels):
            longer = self.levels[level + 1]
            out[longer.link[longer.count == self.levels[level].count[longer.link]]] = True
        return out

    def states(self):
        """(level, place, least level): the longest substring of each state, and how short its members get along its links."""
        for i in range(len(self.levels)):
            longest = np.flatnonzero(~self.absorbed(i))
            short, at = np.full(len(longest), i), longest
            for j in range(i, 0, -1):
                at = self.levels[j].link[at]
                joins = (short == j) & (self.levels[j - 1].count[at] == self.levels[i].count[longest])
                short[joins] = j - 1
            yield i, longest, short

    def text(self, level: int, places: np.ndarray) -> list[np.ndarray]:
        """The words of the substrings, a column for each of their places, by following transitions back."""
        out = []
        for i in range(level, -1, -1):
            out.append(self.levels[i].label[places])
            places = self.levels[i].source[places]
        return out[::-1]

    def keys(self, own: np.ndarray) -> list[np.ndarray]:
        """A 64-bit hash for each substring of each level, from those of the words."""
        out = [own]
        for i, level in enumerate(self.levels[1:], 2):
            out.append(splitmix(out[-1][level.source] * np.uint64(0x9FB21C651E98DF25) + own[level.label] + np.uint64(i)))
        return out


# ---------------------------------------------------------------- shards
class Shard:
    """Words of some pieces, numbered with their language."""

    def __init__(self, data, lengths, head, langs, names):
        codes, distinct = dictionary(data, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
        pairs, self.words = np.unique(langs.astype(np.int64) * max(1, len(distinct)) + codes, return_inverse=True)
        self.lang, word = np.divmod(pairs, max(1, len(distinct)))
        self.names, self.head = names, head
        self.spelt = distinct.cast(pa.large_string()).take(pa.array(word))
        text, offsets = utf8_view(self.spelt)
        seeds = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], dtype=np.uint64)
        self.own = splitmix(hash_spans(text, offsets[:-1], offsets[1:], lower=False) ^ seeds[self.lang])

    def automaton(self, depth: int) -> Automaton:
        return Automaton(self.words, self.head, len(self.lang), depth)


def shards(source, size: int = SHARD_WORDS):
    """Shards of about ``size`` words from batches of (lang, text), cut where a piece begins."""
    held, count, names = [], 0, {}
    for batch in batches(source):
        text, offsets = utf8_view(batch.column(1))
        text = LOWER[text]
        starts, ends = word_spans(text, offsets, BLANK | BREAK)
        of = np.array([names.setdefault("und" if x is None else x, len(names)) for x in batch.column(0).to_pylist()], dtype=np.int32)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        breaks = np.cumsum(BREAK[text], dtype=np.int32)
        piece = breaks[starts] if len(starts) else starts
        head = np.concatenate([[True], (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])])[: len(starts)]
        inside = ~(BLANK | BREAK)[text]
        data, lengths, langs = text[inside], (ends - starts).astype(np.int32), of[rows]
        at, taken = 0, 0
        while at < len(starts):
            to = min(len(starts), at + size - count)
            later = np.flatnonzero(head[to:])  # on to where the next piece begins
            to = to + int(later[0]) if len(later) else len(starts)
            stop = taken + int(lengths[at:to].sum())
            held.append((data[taken:stop].copy(), lengths[at:to], head[at:to], langs[at:to]))
            count, at, taken = count + to - at, to, stop
            if count >= size:
                whole, held, count = [*map(np.concatenate, zip(*held))], [], 0
                yield Shard(*whole, list(names))
                give_back()
    if held:
        yield Shard(*map(np.concatenate, zip(*held)), list(names))
    give_back()


def passing(texts: DataFrame, ranges: int, depth: int, least: int) -> np.ndarray:
    """2**FILTER_BITS bits, packed: those of the hashes that reach ``least`` over all shards are set.

    ``ranges`` is the number of leading bits that choose a range of hashes. The filter is the only thing gathered: 16 MB.
    """

    def count(source):
        for shard in shards(source):
            made = shard.automaton(depth)
            key = np.concatenate(made.keys(shard.own))
            n = np.minimum(np.concatenate([x.count for x in made.levels]), least)
            order = np.argsort(key)
            key, n = key[order], n[order]
            place = (key >> np.uint64(64 - ranges)).astype(np.int64) if ranges else np.zeros(len(key), np.int64)
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
            low = (key >> np.uint64(32 - ranges)).astype(np.uint32)
            kind = "u1" if least < 256 else "<u4"
            stops = np.append(heads[1:], len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[heads].astype(np.int32)), pa.array([low[a:b].astype("<u4").tobytes() for a, b in zip(heads, stops)], pa.binary()), pa.array([n[a:b].astype(kind).tobytes() for a, b in zip(heads, stops)], pa.binary())],
                names=["range", "keys", "counts"],
            )

    def add(table):
        kind, spare = "u1" if least < 256 else "<u4", FILTER_BITS - ranges
        key = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(key)
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        bits = np.zeros(1 << spare, dtype=bool)
        bits[key[heads][np.add.reduceat(n, heads) >= least] >> np.uint32(32 - spare)] = True
        return pa.table({"range": table.column("range").slice(0, 1), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    size = 1 << FILTER_BITS - ranges - 3
    for r in texts.mapInArrow(count, "range int, keys binary, counts binary").groupBy("range").applyInArrow(add, "range int, bits binary").collect():
        out[r.range * size : (r.range + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def phrase_counts(texts: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f) for every phrase of up to ``depth`` words with f >= ``least``; with 0 words, f is that of all words.

    ``texts`` has lang and text, in this order.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(FILTER_BITS - 3, max(0, int(total // RANGE_BYTES).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(passing(texts, ranges, depth, least))

    def names(source):
        bits = shared.value
        for shard in shards(source):
            made = shard.automaton(depth)
            langs = pa.array(shard.names)
            sums = np.bincount(shard.lang, weights=made.levels[0].count, minlength=len(langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs)), pa.array(sums)], names=["lang", "words", "phrase", "f"])
            for i, key in enumerate(made.keys(shard.own)):
                spot = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                some = np.flatnonzero(bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
                if not len(some):
                    continue
                columns = made.text(i, some)
                phrase = pc.binary_join_element_wise(*(shard.spelt.take(pa.array(c)) for c in columns), pa.scalar(" ", pa.large_string())) if i else shard.spelt.take(pa.array(columns[0]))
                lang = langs.take(pa.array(shard.lang[columns[0]]))
                for at in range(0, len(some), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([lang[part], pa.array(np.full(len(some[part]), i + 1, np.int32)), phrase[part].cast(pa.string()), pa.array(made.levels[i].count[some[part]].astype(np.int64))], names=["lang", "words", "phrase", "f"])

    found = texts.mapInArrow(names, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


# ---------------------------------------------------------------- scores
def _words(phrase: str, first: int, last) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, last), " ")


def collocations(documents: DataFrame, depth: int = DEPTH, least: int = LEAST, covered: int = COVERED, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``depth`` words of each language.

    Null texts count as empty and null languages as ``und``; a table without phrases gives no rows. Repeated rows count
    each time. Equal scores are ordered by a, then by the phrase's bytes, so ranks are the same in any run. Other columns
    are left out. Counts up to 10**15 are exact. A piece is never cut: a task holds about 100 bytes a word of its
    longest one, and ten bytes a byte of its longest text.
    """
    texts = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with scratch() as keep:
        counts = keep(phrase_counts(texts, depth, least), "phrases")
        totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
        every = totals.agg(F.sum("n")).first()[0] or 0
        longer = counts.where("words > 2").withColumn("inner", F.explode(F.array(_words("phrase", 1, F.col("words") - 1), _words("phrase", 2, F.col("words") - 1))))
        cover = longer.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("f").alias("_most"))
        own = counts.where("words > 1").join(cover, ["lang", "phrase"], "left").where((F.col("_most") * 100 < F.col("f") * covered) | F.col("_most").isNull())
        cuts = own.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = keep(cuts.select("lang", "phrase", "a", "k", _words("phrase", 1, F.col("k")).alias("left"), _words("phrase", F.col("k") + 1, F.col("words")).alias("right")), "cuts")
        parts = counts.where((F.col("words") > 0) & (F.col("words") < depth))
        # a part that is a hot key has a large share of all words: at most 4,096 of each length have more than one in 4,096
        on_left = join_unique(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"], "l", every).drop("left")
        both = join_unique(keep(on_left, "left"), parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"], "r", every).drop("right")
        exact = "CAST(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
        lowest = both.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut")).select("lang", "phrase", "a", "_cut.*").drop("k")
        # the first of each of some parts of a language, then the first of these
        by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        some = lowest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("rank") <= top).drop("rank", "_part")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
        return materialize(ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, words, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE words > 1 AND f >= 10),
x AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
m AS (SELECT lang, phrase, max(a) AS most FROM x GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
k AS (SELECT *, unnest(range(1, words)) AS k FROM o),
s AS (SELECT k.lang, k.phrase, a, k, fl.f AS l, fr.f AS r, (1000000 * a * a) // (fl.f * fr.f) AS score
  FROM k JOIN f fl ON fl.lang = k.lang AND fl.phrase = array_to_string(ws[1:k], ' ') JOIN f fr ON fr.lang = k.lang AND fr.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
