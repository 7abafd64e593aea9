"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(group | class, history) + log P(type | group, history) + log P(word | type).

* Tokens are lower-cased (A-Z) runs without white space, then one end token a text, counted over all training texts.
* A word's type is the word itself if it is among the TYPES commonest, else a hash of its last three bytes, so that
  every word, known or not, has a type. Types stand in a tree of three levels of at most WIDTH branches: classes, groups
  within a class, types within a group. They are clustered by the company they keep: counts of the commonest words before
  and after them over the whole corpus. The commonest types are classes or groups of their own.
* Each choice of a branch is a softmax over hashed features of the history at that place of the tree: a bias, the type
  before, the type before that (a skip feature), and the pair of both. All weights are learned together by distributed
  gradient updates: each learner runs adaptive minibatch steps over its shard from common weights, and changes are
  averaged by how often each learner met a feature; every training text is used once, in ROUNDS rounds. Shards, their
  order and the number of features follow from the training tokens alone, so that results don't depend on the cluster.
* A type that stands for rare words gives each its discounted share, and the discount to unknown words.

Broadcast are the counts of at most HEAD words and the weights, of bounded size; counts of all other words are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, counts_to_rows, hash_spans, key_residue, materialize, scratch, splitmix, utf8_view, word_spans

HEAD = 1 << 17
TYPES = 1 << 14
SUFFIXES = 1 << 11
WIDTH = 32
SINGLE = 8
NEAR = 32
ROUNDS = 2
STEP = 8192
END = np.uint64(0x1D8E4E27C47D124F)
START_TYPE = TYPES + SUFFIXES
# places of the tree: the root, its classes, their groups
NODES = 1 + WIDTH + WIDTH * WIDTH
CHUNK = 128


# ---------------------------------------------------------------- tokens
def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix cell of each token, end tokens included, and where each text's tokens begin."""
    text, offsets = utf8_view(column)
    starts, ends = word_spans(text, offsets)
    h = hash_spans(text, starts, ends)
    bounds = np.searchsorted(starts, offsets, side="left").astype(np.int64)
    n, docs = len(h), len(bounds) - 1
    tail = np.zeros(n, np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        byte = np.where(at >= starts, text[np.maximum(at, 0)], 0) if n else np.zeros(0, np.uint8)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        tail = tail * np.uint64(257) + byte.astype(np.uint64)
    cell = (splitmix(tail) % np.uint64(SUFFIXES)).astype(np.int64)
    place = np.arange(n) + counts_to_rows(bounds)
    stops = bounds[1:] + np.arange(docs)
    all_h, all_cell = np.empty(n + docs, np.uint64), np.zeros(n + docs, np.int64)
    all_h[place], all_cell[place] = h, cell
    all_h[stops] = END
    return all_h, all_cell, np.concatenate([[0], stops + 1])


class Lexicon:
    """Sorted hashes of the head words with their counts, types and suffix cells; once known, the discount and log10 of each cell's tokens."""

    discount, cell_room = 0.5, np.zeros(SUFFIXES)

    def __init__(self, words: np.ndarray, counts: np.ndarray, cells: np.ndarray):
        rank = np.lexsort((words, -counts))
        types = np.full(len(words), -1, np.int32)
        own = rank[:TYPES]
        if END in words[rank[TYPES:]]:
            own = np.concatenate([own[:-1], np.flatnonzero(words == END)])
        types[own] = np.arange(len(own))
        order = np.argsort(words)
        self.words, self.counts, self.types, self.cells = words[order], counts[order].astype(np.int64), types[order], cells[order]
        self.near = words[own[:NEAR]]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index among the head words, or -1."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def rare_score(self, counts: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log10 of the discounted share of words in their cells."""
        return np.log10(counts - self.discount) - self.cell_room[cell]

    def type_of(self, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
        known = np.where(at >= 0, self.types[np.maximum(at, 0)] if len(self.types) else -1, -1)
        return np.where(known >= 0, known, TYPES + cell).astype(np.int64)


def histories(types: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The types one and two tokens before; before a text stands the start type."""
    one, two = np.full(len(types), START_TYPE), np.full(len(types), START_TYPE)
    one[1:], two[2:] = types[:-1], types[:-2]
    first = bounds[:-1]
    one[first] = START_TYPE
    two[first] = START_TYPE
    second = first[np.diff(bounds) > 1] + 1
    two[second] = START_TYPE
    return one, two


def feature_size(tokens: int) -> int:
    """Rows of each of the three hashed tables: they double with the training tokens, from 2**12 to 2**16 (25 MB in all)."""
    return 1 << int(np.clip(np.floor(np.log2(max(tokens, 1) / 2048)), 12, 16))


def shard_tokens(size: int) -> int:
    """Training tokens of a learner: so many that it sends less than half of what it reads."""
    return 128 * size


class Tree:
    """Path of each type: three (place, branch) steps, and how many of them are a choice at all."""

    def __init__(self, table: np.ndarray, words: int):
        """table: ``company`` of each type; words: how many types are words of their own. Types of rare words are never ruled out."""
        own = table[:, -1]
        least = np.where((np.arange(len(table)) < words) | (np.arange(len(table)) >= TYPES), 0.5, 1e-6)
        n = len(table)
        self.path, self.depth = np.zeros((n, 3), np.int64), np.ones(n, np.int64)
        share = np.sqrt((table[:, :-1] + 1e-3) / (table[:, :-1].sum(axis=1, keepdims=True) + 1e-3 * (table.shape[1] - 1)))
        for c, members in enumerate(branches(share, own, np.arange(n), SINGLE, WIDTH * WIDTH)):
            self.path[members, 0] = c
            if len(members) > 1:
                m = max(-(-(len(members) - WIDTH) // (WIDTH - 1)), min(WIDTH // 2, len(members) // 8), 0)
                for g, inner in enumerate(branches(share, own, members, WIDTH - m, WIDTH)):
                    self.path[inner, 1] = g
                    self.depth[inner] = 2
                    if len(inner) > 1:
                        self.path[inner, 2] = np.arange(len(inner))
                        self.depth[inner] = 3
        self.bias = np.full((NODES, WIDTH), -1e4, np.float32)
        for level in range(3):
            here = self.depth > level
            counts = np.bincount(self.place(level)[here] * WIDTH + self.path[here, level], weights=(own + least)[here], minlength=NODES * WIDTH).reshape(NODES, WIDTH)
            some = counts.sum(axis=1) > 0
            with np.errstate(divide="ignore"):
                shares = np.log(counts[some] / counts[some].sum(axis=1, keepdims=True))
            self.bias[some] = np.where(np.isfinite(shares), shares, -1e4)

    def place(self, level: int) -> np.ndarray:
        """The place at which each type's step of the level is chosen."""
        if level == 0:
            return np.zeros(len(self.path), np.int64)
        return 1 + self.path[:, 0] if level == 1 else 1 + WIDTH + WIDTH * self.path[:, 0] + self.path[:, 1]

    def steps(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, place, branch) of all choices that the tokens' types take, the first of all tokens first."""
        token, place, branch = [], [], []
        for level in range(3):
            at = np.flatnonzero(self.depth[types] > level)
            token.append(at)
            place.append(self.place(level)[types[at]])
            branch.append(self.path[types[at], level])
        return np.concatenate(token), np.concatenate(place), np.concatenate(branch)


def branches(share: np.ndarray, own: np.ndarray, members: np.ndarray, single: int, room: int, most: int = WIDTH) -> list[np.ndarray]:
    """At most ``most`` groups of the members: the ``single`` commonest alone, the others clustered with ``room`` in a cluster."""
    members = members[np.argsort(-own[members], kind="stable")]
    if len(members) <= most:
        return [members[i : i + 1] for i in range(len(members))]
    rest = members[single:]
    return [*(members[i : i + 1] for i in range(single)), *(g for g in clusters(share[rest], own[rest], rest, most - single, room) if len(g))]


def clusters(share: np.ndarray, own: np.ndarray, members: np.ndarray, k: int, room: int, rounds: int = 8) -> list[np.ndarray]:
    """k-means of the members' shares with at most ``room`` in a cluster: those that it can't hold go to the next nearest."""
    pull = np.sqrt(own + 1e-9)
    # the first centre is the commonest, each next one the farthest from all so far, weighed by its count
    middle = np.empty((k, share.shape[1]))
    middle[0] = share[0]
    gap = ((share - middle[0]) ** 2).sum(axis=1)
    for c in range(1, k):
        middle[c] = share[np.argmax(gap * pull)]
        gap = np.minimum(gap, ((share - middle[c]) ** 2).sum(axis=1))
    weight = own + 1e-6
    for _ in range(rounds):
        far = 0.5 * (middle**2).sum(axis=1) - share @ middle.T
        near = far.argmin(axis=1)
        total = np.bincount(near, weights=weight, minlength=k)
        for c in np.flatnonzero(total):
            mine = near == c
            middle[c] = weight[mine] @ share[mine] / total[c]
    order, taken, home = np.argsort(far, axis=1), np.zeros(k, np.int64), np.full(len(members), -1)
    for turn in range(k):
        # members stand by falling count, so the commonest keep their nearest
        asks = np.flatnonzero(home < 0)
        if not len(asks):
            break
        for c in range(k):
            mine = asks[order[asks, turn] == c][: room - taken[c]]
            home[mine] = c
            taken[c] += len(mine)
    return [members[home == c] for c in range(k)]


def feature_rows(place: np.ndarray, one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """4 x n rows of the weight table: the place's bias, and by place the type before, the type two before, and their pair."""
    a, b, p = one.astype(np.uint64), two.astype(np.uint64), place.astype(np.uint64) << np.uint64(40)
    cut = np.uint64(size - 1)
    made = (p + a + np.uint64(1 << 20), p + b + np.uint64(1 << 21), p + a * np.uint64(1 << 16) + b + np.uint64(1 << 38))
    return np.stack([place, *(NODES + i * size + (splitmix(x) & cut).astype(np.int64) for i, x in enumerate(made))])


def _raised(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n x WIDTH scores less their row's greatest, their exponentials, and the sums of these."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e.sum(axis=1)


def type_scores(weights: np.ndarray, tree: Tree, types: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The log-probability (natural) of each token's type after its history."""
    size, out = (len(weights) - NODES) // 3, np.zeros(len(types))
    for a in range(0, len(types), STEP):
        s = slice(a, a + STEP)
        token, place, branch = tree.steps(types[s])
        z, _, total = _raised(weights, feature_rows(place, one[s][token], two[s][token], size))
        out[s] = np.bincount(token, weights=z[np.arange(len(token)), branch] - np.log(total), minlength=len(types[s]))
    return out


# ---------------------------------------------------------------- corpus statistics
def count_words(texts: DataFrame) -> DataFrame:
    """(h, c, cell): how often each hashed token stands in the texts, and its suffix cell; summed within partitions before the shuffle."""

    def run(source):
        held, size = [], 0

        def merged():
            h, c, cell = (np.concatenate(x) for x in zip(*held))
            words, first, at = np.unique(h, return_index=True, return_inverse=True)
            return words, np.bincount(at, weights=c, minlength=len(words)).astype(np.int64), cell[first]

        def out(words, c, cell):
            for a in range(0, len(words), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(words[s].view(np.int64)), pa.array(c[s]), pa.array(cell[s].astype(np.int32))], names=["h", "c", "cell"])

        for batch in batches(source):
            h, cell, _ = tokens_of(batch.column("text"))
            words, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((words, c.astype(np.int64), cell[first]))
            size += len(words)
            if size > 1 << 20:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from out(*held.pop())
                    size = 0
        if held:
            yield from out(*merged())

    return texts.select("text").mapInArrow(run, "h long, c long, cell int").groupBy("h").agg(F.sum("c").alias("c"), F.min("cell").alias("cell"))


def head_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most HEAD of the commonest words: all from the least count (in steps of a 64th of a power of two) at which they are no more."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.s):
        if held + r.n > HEAD:
            break
        held, least = held + r.n, r.s
    end = counts.where(F.col("h") == F.lit(int(END.view(np.int64))))
    rows = [] if least is None else counts.where(step >= least).unionByName(end).distinct().collect()
    return np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64), np.array([r.cell for r in rows], np.int64)


def cell_sums(counts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each suffix cell, without the words that are types themselves."""
    tokens, words = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.groupBy("cell").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[r.cell], words[r.cell] = r.c, r.n
    own = lexicon.types >= 0
    tokens -= np.bincount(lexicon.cells[own], weights=lexicon.counts[own], minlength=SUFFIXES)
    words -= np.bincount(lexicon.cells[own], minlength=SUFFIXES)
    return tokens, words


def sum_blocks(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of float32 blocks by ``chunk``, in the order of ``shard``. The chunks are few and of fixed size; a task holds one block of each of its own."""

    def run(source):
        sums: dict[int, np.ndarray] = {}
        for batch in source:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), np.float32)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.astype(np.float64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "data"])

    rows = parts.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(run, "chunk int, data binary").collect()
    return {r.chunk: np.frombuffer(r.data, np.float32).reshape(-1, width) for r in rows}


def _blocks(shard: int, table: np.ndarray, touched: np.ndarray):
    """Record batches of the table's chunks of CHUNK rows in which any row was touched."""
    for c in np.unique(np.flatnonzero(touched) // CHUNK):
        data = np.ascontiguousarray(table[c * CHUNK : (c + 1) * CHUNK], np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([c], pa.int32()), pa.array([data], pa.binary())], names=["shard", "chunk", "data"])


def _assembled(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    total = np.zeros((-(-rows // CHUNK) * CHUNK, width), np.float32)
    for chunk, data in sum_blocks(parts, width).items():
        total[chunk * CHUNK : chunk * CHUNK + len(data)] = data
    return total[:rows]


BLOCKS = "shard long, chunk int, data binary"


def typed(texts: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns with, per text: tokens, their types, and what the head's counts say; the other words, once a text."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)
    kept = texts.select(*keep, "text")

    def run(source):
        lex = shared.value
        for batch in batches(source):
            h, cell, bounds = tokens_of(batch.column("text"))
            n, row, at = batch.num_rows, counts_to_rows(bounds), lex.find(h)
            ty = lex.type_of(at, cell)
            head = at >= 0
            c = lex.counts[at[head]]
            rare = head & (ty >= TYPES)
            base, mass = np.zeros(len(h)), np.zeros(len(h))
            base[head] = np.log10(c + 1)
            mass[rare] = lex.rare_score(lex.counts[at[rare]], cell[rare])
            key = np.stack([row[~head], h[~head].view(np.int64), cell[~head]], axis=1)
            key = key[np.lexsort((key[:, 1], key[:, 0]))]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:, :2] != key[:-1, :2]).any(axis=1)
            cut = np.flatnonzero(new)
            offsets = pa.array(np.searchsorted(key[cut, 0], np.arange(n + 1)).astype(np.int32))
            codes = ty.astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep), pa.array(np.diff(bounds)), pa.array(np.bincount(row, weights=head, minlength=n).astype(np.int64)), pa.array(np.bincount(row, weights=base, minlength=n)), pa.array(np.bincount(row, weights=mass, minlength=n)),
                    pa.array([codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(key[cut, 1])), pa.ListArray.from_arrays(offsets, pa.array(key[cut, 2].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(cut, len(key))).astype(np.int32))),
                ],
                names=[*keep, "n_tokens", "_known", "_base", "_mass", "_types", "_h", "_cell", "_times"],
            )

    more = "n_tokens long, _known long, _base double, _mass double, _types binary, _h array<long>, _cell array<int>, _times array<int>"
    return kept.mapInArrow(run, T.StructType([*(kept.schema[k] for k in keep), *T._parse_datatype_string(more).fields]))


def types_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Types of all tokens of a column of ``_types``, and where each text's begin."""
    parts = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), bounds


def company(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """types x (2 NEAR + 1): how often each of the NEAR commonest words stands before and after a type; last, the type's own count."""
    kinds, width = START_TYPE + 1, 2 * NEAR + 1
    near = np.full(kinds, NEAR)
    at = lexicon.find(lexicon.near)
    near[lexicon.types[at]] = np.arange(len(at))

    def run(source):
        table = np.zeros((kinds, 2 * NEAR + 2))
        for batch in batches(source):
            ty, bounds = types_of(batch.column("_types"))
            one, _ = histories(ty, bounds)
            inner = one != START_TYPE
            for who, other, shift in ((ty[inner], one[inner], 0), (one[inner], ty[inner], NEAR)):
                col = near[other]
                seen = col < NEAR
                table.ravel()[:] += np.bincount(who[seen] * (2 * NEAR + 2) + col[seen] + shift, minlength=table.size)
            table[:, 2 * NEAR] += np.bincount(ty, minlength=kinds)
        # whole numbers: in any order they have one sum
        yield from _blocks(0, table[:, :width], table[:, 2 * NEAR] > 0)

    return _assembled(texts.select("_types").mapInArrow(run, BLOCKS), kinds, width).astype(np.float64)


# ---------------------------------------------------------------- gradient updates
def learn(weights: np.ndarray, tree: Tree, texts: list[np.ndarray], rate: float, power: np.ndarray, used: np.ndarray) -> None:
    """Adaptive minibatch steps over texts (their types), in place."""
    size = (len(weights) - NODES) // 3
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    types = np.concatenate(texts).astype(np.int64)
    one, two = histories(types, bounds)
    seen, slot = np.zeros(len(weights), bool), np.zeros(len(weights), np.int64)
    for a in range(0, len(types), STEP):
        s = slice(a, a + STEP)
        token, place, branch = tree.steps(types[s])
        rows = feature_rows(place, one[s][token], two[s][token], size)
        _, g, total = _raised(weights, rows)
        g /= total[:, None]
        g[np.arange(len(token)), branch] -= 1
        # sums by weight row, a column at a time: each kind of feature has rows of its own
        columns = np.ascontiguousarray(g.T, np.float64)
        for r in rows:
            seen[r] = True
            at = np.flatnonzero(seen)
            seen[at] = False
            slot[at] = np.arange(len(at))
            which = slot[r]
            step = np.empty((len(at), WIDTH), np.float32)
            for j in range(WIDTH):
                step[:, j] = np.bincount(which, weights=columns[j], minlength=len(at))
            power[at] += np.einsum("ij,ij->i", step, step) / WIDTH
            step *= (rate / np.sqrt(power[at]))[:, None]
            weights[at] -= step
            used[at] += np.bincount(which, minlength=len(at))


def learn_round(texts: DataFrame, tree: Tree, weights: np.ndarray, rate: float, shards: int) -> np.ndarray:
    """Weights after each learner's pass over its shard, changes averaged by use. texts: _shard, _order, _types."""
    shared = texts.sparkSession.sparkContext.broadcast((tree, weights))
    enough = 1 << 17

    def run(source):
        tree, start = shared.value
        now, held, size = None, [], 0
        w = power = used = None

        def done():
            if held:
                learn(w, tree, held, rate, power, used)
            table = np.concatenate([(w - start) * used[:, None], used[:, None]], axis=1, dtype=np.float32)
            yield from _blocks(now, table, used > 0)

        for batch in source:
            for shard, data in zip(batch.column("_shard").to_pylist(), batch.column("_types")):
                if shard != now:
                    if now is not None:
                        yield from done()
                    now, held, size = shard, [], 0
                    w, power, used = start.copy(), np.ones(len(start), np.float32), np.zeros(len(start), np.float32)
                held.append(np.frombuffer(data.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= enough:
                    learn(w, tree, held, rate, power, used)
                    held, size = [], 0
        if now is not None:
            yield from done()

    dealt = texts.repartitionById(shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", "_order").select("_shard", "_types")
    total = _assembled(dealt.mapInArrow(run, BLOCKS), len(weights), WIDTH + 1)
    return weights + total[:, :-1] / np.maximum(total[:, -1:], 1)


class Model:
    """What scoring broadcasts beside the lexicon: the tree and the weights."""

    def __init__(self, tree: Tree, weights: np.ndarray):
        self.tree, self.weights = tree, weights


def train(texts: DataFrame, tokens: int, lexicon: Lexicon, rate: float = 0.15) -> Model:
    """The model of the typed texts, which hold so many tokens."""
    tree = Tree(company(texts, lexicon)[:START_TYPE], int((lexicon.types >= 0).sum()))
    size = feature_size(tokens)
    weights = np.concatenate([tree.bias, np.zeros((3 * size, WIDTH), np.float32)])
    shards = max(1, round(tokens / ROUNDS / shard_tokens(size)))
    mixed = texts.select("_types", F.xxhash64("doc_id", "_types").alias("_order"))
    dealt = mixed.withColumn("_round", F.pmod("_order", F.lit(ROUNDS))).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)))
    for r in range(ROUNDS):
        weights = learn_round(dealt.where(F.col("_round") == r), tree, weights, rate / (1 + r), shards)
    return Model(tree, weights)


# ---------------------------------------------------------------- scoring
def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``_score`` of typed texts: the model's log10 probability of their types, in sparse numpy batches."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.select(*keep, "_types")

    def run(source):
        m = shared.value
        for batch in batches(source):
            ty, bounds = types_of(batch.column("_types"))
            mass = type_scores(m.weights, m.tree, ty, *histories(ty, bounds)) / np.log(10)
            made = pa.array(np.bincount(counts_to_rows(bounds), weights=mass, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), made], names=[*keep, "_score"])

    return kept.mapInArrow(run, T.StructType([*(kept.schema[k] for k in keep), T.StructField("_score", T.DoubleType())]))


def lm_scores(documents: DataFrame, holdout: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents``.

    Texts whose key's crc32 modulo 7 is ``holdout`` are scored and never learned from. A null text is an empty one, of
    one token. Repeated rows have equal scores. Without any training text all tokens are unknown; an empty table gives an
    empty result.
    """
    rows = documents.select("doc_id", "text", (key_residue("doc_id", 7) == holdout).alias("held_out"))
    with scratch() as keep:
        counts = keep(count_words(rows.where(~F.col("held_out"))), "word-counts")
        one, two = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), one.alias("n1"), two.alias("n2")).first()
        lexicon = Lexicon(*head_of(counts))
        lexicon.discount = min(0.95, max(0.05, stats.n1 / (stats.n1 + 2 * stats.n2))) if stats.n1 else 0.5
        tokens, words = cell_sums(counts, lexicon)
        # what a rare word's type gives each of its words; a cell that training never met leaves all to unknown words
        lexicon.cell_room = np.log10(np.maximum(tokens, 1))
        unknown = np.where(words > 0, np.log10(np.maximum(lexicon.discount * words, 1e-9)) - lexicon.cell_room, 0.0)
        coded = keep(typed(rows, lexicon, ["doc_id", "held_out"]).withColumn("_row", F.monotonically_increasing_id()), "typed")
        model = train(coded.where(~F.col("held_out")), stats.n, lexicon)
        scored = score(coded, model, ["_row", "doc_id", "held_out", "n_tokens", "_known", "_base", "_mass"])

        cells = documents.sparkSession.createDataFrame([(i, float(r), float(u)) for i, (r, u) in enumerate(zip(lexicon.cell_room, unknown))], "cell int, _room double, _unknown double")
        tails = coded.select("_row", F.explode(F.arrays_zip("_h", "_cell", "_times")).alias("t")).select("_row", F.col("t._h").alias("h"), F.col("t._cell").alias("cell"), F.col("t._times").alias("times"))
        met = tails.join(counts.select("h", "c"), "h", "left").join(F.broadcast(cells), "cell")
        known = F.col("c").isNotNull()
        sums = met.groupBy("_row").agg(
            F.sum(F.when(known, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("base"),
            F.sum(F.col("times") * F.when(known, F.log10(F.col("c") - F.lit(lexicon.discount)) - F.col("_room")).otherwise(F.col("_unknown"))).alias("mass"),
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        done = scored.join(sums, "_row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("_known") + zero("known")).alias("n_known"),
            F.lit(int(stats.n)).cast("long").alias("train_tokens"),
            (F.col("_base") + zero("base") - F.col("n_tokens") * F.lit(float(np.log10(stats.n + stats.v + 1)))).alias("base_score"),
            (F.col("_score") + F.col("_mass") + zero("mass")).alias("score"),
        )
        return materialize(done, "lm-scores")
