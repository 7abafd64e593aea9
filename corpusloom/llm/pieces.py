"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text has an edge for each vocabulary piece that matches at a position, and byte pieces where a
character has no piece. Pieces weigh by rank as Zipf-Mandelbrot probabilities, since a merge model scores ranks only.
Backward sums turn weights into exact conditional probabilities of the next piece, so a path's log-probability is a sum
of choices. The k segmentations are the k largest Gumbel-perturbed leaves, found best first (A*): the bound of an open
branch is the exact maximum of its subtree, drawn from a Gumbel truncated at its parent's. Noise is hashed from the row's
key, so that a text's samples depend on neither partitioning nor neighbours.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, splitmix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, MARK = 0x20, 0x2581
OFFSET = 2.7
BYTE_PENALTY = 3.0
# bytes of text at a time: a lattice takes up to a hundred bytes for each of them
BATCH = 1 << 19
_BASE = 0xF1357AEA2E62A9C5
_MASK = (1 << 64) - 1


class Vocabulary:
    """Pieces by 64-bit hash of their code points, with log-probabilities and the bytes that each decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes_of: list[bytes] = [b""] * n
        ids, ranks, self.longest = [], [], 1
        begun: dict[int, int] = {}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if chr(MARK) in piece.lstrip(chr(MARK)):
                    raise ValueError("a piece that crosses a word's beginning")
                self.bytes_of[i] = piece.replace(chr(MARK), " ").encode()
                ids.append(i)
                ranks.append(-model.get_score(i))
                points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
                self.longest = max(self.longest, len(points))
                for size, h in enumerate(hash_ranges(points, np.zeros(len(points), np.int64), np.arange(1, len(points) + 1)), 1):
                    begun[int(h)] = len(ids) - 1 if size == len(points) else begun.get(int(h), -1)
        self.ids = np.array(ids, np.int32)
        weight = -np.log(np.maximum(np.array(ranks), 0.0) + OFFSET)
        weight -= np.log(np.exp(weight).sum())
        self.logp = weight.astype(np.float32)
        self.byte_logp = float(weight.min()) - BYTE_PENALTY
        # all beginnings of pieces by hash, with a direct table over the leading bits; crowded cells are searched
        self.prefixes = np.array(sorted(begun), np.uint64)
        self.entry_of = np.array([begun[int(h)] for h in self.prefixes], np.int32)
        self.bits = 20
        slot = (self.prefixes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1

    def find(self, nodes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each hashed string (-1 for a mere beginning), and its node; strings that begin no piece are left out."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.table[slot]
        good = (at >= 0) & (self.prefixes[at] == h)
        lost = np.flatnonzero(~good & (at >= 0) & self.crowded[slot])
        if len(lost):
            place = np.minimum(np.searchsorted(self.prefixes, h[lost]), len(self.prefixes) - 1)
            same = self.prefixes[place] == h[lost]
            at[lost[same]], good[lost[same]] = place[same], True
        return self.entry_of[at[good]], nodes[good]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base & _MASK, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def hash_ranges(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = splitmix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, len(points))[: len(points)])])
    back = _powers(pow(_BASE, -1, 1 << 64), len(points))
    return splitmix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((splitmix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range in turn."""
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return first + np.arange(len(first))


class Lattice:
    """Lattices of distinct units: node i is a code point of a unit, column l - 1 the piece of l code points from it."""

    def __init__(self, v: Vocabulary, points: np.ndarray, starts: np.ndarray):
        n = len(points)
        sizes = np.diff(np.append(starts, n))
        end = np.repeat(starts + sizes, sizes)
        left = end - np.arange(n)
        self.end, self.v, self.points = end.astype(np.int32), v, points.astype(np.int32)
        value = splitmix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, n)[:n])])
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        # pieces of each length; a node goes on while what it has read begins some piece
        found, at = [], np.arange(n)
        for size in range(1, v.longest + 1):
            at = at[left[at] >= size]
            hit, at = v.find(at, splitmix((total[at + size] - total[at]) * back[at] + np.uint64(size)))
            found.append((at[hit >= 0], hit[hit >= 0]))
            if not len(at):
                break
        width = max([i + 1 for i, (x, _) in enumerate(found) if len(x)], default=1)
        self.entry = np.full((n, width), -1, np.int32)
        weight = np.full((n, width), -np.inf, np.float32)
        for i, (nodes, hit) in enumerate(found[:width]):
            self.entry[nodes, i] = hit
            weight[nodes, i] = v.logp[hit]
        alone = np.flatnonzero(self.entry[:, 0] < 0)
        p = points[alone]
        weight[alone, 0] = (1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)) * v.byte_logp
        beta = np.zeros(n + 1, np.float32)
        order = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, (left.max() if n else 0) + 2))
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            at = order[a:b]
            m = min(width, r)
            z = weight[at, :m]
            for j in range(m if m < r else m - 1):
                z[:, j] += beta[at + j + 1]
            top = z.max(axis=1)
            z = np.exp(z - top[:, None])
            s = z.sum(axis=1)
            beta[at] = top + np.log(s)
            weight[at, :m] = z / s[:, None]
            weight[at, m:] = 0
        self.chance = weight
        self.best = weight.argmax(axis=1)
        line = np.arange(n)
        self.best_chance = weight[line, self.best]
        # what is left beside the likeliest piece, exact where it is far below the precision of one
        weight[line, self.best] = 0
        self.besides = weight.sum(axis=1)
        weight[line, self.best] = self.best_chance

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Column of a draw from each node's choices. The likeliest piece comes first on the unit line, the others after it."""
        picked = self.best[at]
        rest = np.flatnonzero(u >= self.best_chance[at])
        if len(rest):
            here = at[rest]
            others = self.chance[here]
            line = np.arange(len(rest))
            others[line, picked[rest]] = 0
            left = (u[rest] - self.best_chance[here])[:, None]
            col = np.minimum((np.cumsum(others, axis=1) <= left).sum(axis=1), others.shape[1] - 1)
            # draws that rounding leaves without a piece keep the likeliest
            picked[rest] = np.where(others[line, col] > 0, col, picked[rest])
        return picked


# the mark as a character of the text itself; such texts use it as a code that no piece holds
OWN_MARK = 0x10FFFF + 1


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with spaces as marks and one mark before each, the starts of the units (marks and what follows
    them), and where each text's units begin. An empty text has no unit."""
    shown = [" " + t if t else "" for t in texts]
    points = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points == MARK, OWN_MARK, np.where(points == SPACE, MARK, points))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
    mark = points == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    begins[edges] = True
    starts = np.flatnonzero(begins)
    return points, starts, np.searchsorted(starts, bounds)


def sample(texts: list[str], seeds: np.ndarray, v: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text at most k (ids, log-probability, inclusion score) of distinct segmentations, by falling perturbed score."""
    n = len(texts)
    points, starts, bounds = units_of(texts)
    if not len(starts):
        return [[(np.zeros(0, np.int32), 0.0, 1.0)] if k else [] for _ in texts]
    ends = np.append(starts[1:], len(points))
    keys = hash_ranges(points, starts, ends)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lattice = Lattice(v, points[_ranges(starts[first], sizes)], offset)
    doc_of_unit = np.repeat(np.arange(n), np.diff(bounds))
    nth_unit = (np.arange(len(starts)) - bounds[doc_of_unit]).astype(np.uint64)
    unit_seed = splitmix(splitmix(seeds[doc_of_unit]) + nth_unit)
    unit_node = offset[which]

    def walk(units: np.ndarray, nodes: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free draws from the given nodes to the units' ends: (unit, node, column), in order of unit and node."""
        at, stop = nodes.copy(), lattice.end[unit_node[units]]
        live, steps, taken = np.flatnonzero(at < stop), [], np.zeros(len(units), np.int64)
        while len(live):
            here, who = at[live], units[live]
            u = _uniform(unit_seed[who] + np.uint64(salt * 0x9E3779B97F4A7C15 & _MASK) + (here - unit_node[who]).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            col = lattice.choose(here, u)
            steps.append((live, here, col))
            taken[live] += 1
            at[live] = here + col + 1
            live = live[at[live] < stop[live]]
        # step s of a unit stands s places after its first
        first = np.cumsum(taken) - taken
        node_, col_ = np.empty(taken.sum(), np.int64), np.empty(taken.sum(), np.int64)
        for s, (who, here, col) in enumerate(steps):
            place = first[who] + s
            node_[place], col_[place] = here, col
        return np.repeat(units, taken), node_, col_

    def gumbel(doc: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
        return -np.log(-np.log(_uniform(splitmix(seeds[doc] ^ np.uint64(salt * 0xD1342543DE82EF95 & _MASK)) + place.astype(np.uint64))))

    def branches(logq: np.ndarray, doc: np.ndarray, cut: np.ndarray, open_: np.ndarray, prefix: np.ndarray, bound: np.ndarray, salt: int, from_: np.ndarray) -> np.ndarray:
        """The greatest perturbed leaf beside each choice of a path from choice ``from_`` on; earlier choices have none."""
        place = np.arange(len(logq)) - cut[doc]
        with np.errstate(divide="ignore"):
            mass = np.log(open_)
        free = prefix + mass + gumbel(doc, place, salt)
        value = np.where(np.isfinite(mass), -np.logaddexp(-bound[doc], -free), -np.inf)
        return np.where(place >= from_[doc], value, -np.inf)

    def prefixes(logq: np.ndarray, cut: np.ndarray, doc: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(logq)])
        return total[:-1] - total[cut[doc]]

    unit, node, col = walk(np.arange(len(starts)), unit_node, 1)
    paths, answers = [], [[] for _ in range(n)]
    alive = np.flatnonzero(np.diff(bounds) > 0)
    value = np.full(n, -np.inf)
    value[alive] = gumbel(alive, np.zeros(len(alive)), 2)
    from_, first_open = np.zeros(n, np.int64), None
    for turn in range(k):
        doc = doc_of_unit[unit]
        chance = lattice.chance[node, col]
        logq = np.log(chance)
        cut = np.searchsorted(doc, np.arange(n + 1))
        open_ = np.where(col == lattice.best[node], lattice.besides[node], 1 - chance).astype(np.float64)
        if first_open is not None:
            # at the changed choice the ones taken before stay closed
            open_[cut[:-1][alive] + from_[alive]] = first_open[alive]
        bound = branches(logq, doc, cut, open_, prefixes(logq, cut, doc), value, 10 + turn, from_)
        paths.append({"unit": unit, "node": node, "col": col, "cut": cut, "bound": bound})
        logp = np.bincount(doc, weights=logq, minlength=n)
        for d in alive:
            answers[d].append((turn, float(logp[d])))
        # the best open branch of each text
        best, owner, where = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t, p in enumerate(paths):
            full = np.flatnonzero(np.diff(p["cut"]) > 0)
            if not len(full):
                continue
            top = np.maximum.reduceat(p["bound"], p["cut"][full])
            better = top > best[full]
            d = full[better]
            best[d], owner[d] = top[better], t
        kappa = best
        if turn == k - 1:
            break
        alive = alive[np.isfinite(best[alive])]
        if not len(alive):
            break
        for t, p in enumerate(paths):
            mine = alive[owner[alive] == t]
            if len(mine):
                rows = np.repeat(mine, np.diff(p["cut"])[mine])
                at = _ranges(p["cut"][mine], np.diff(p["cut"])[mine])
                hit = p["bound"][at] == best[rows]
                d, place = rows[hit], at[hit]
                d, i = np.unique(d, return_index=True)
                where[d] = place[i]
        # the changed choice: a draw among those not taken there before
        new_unit, new_node, new_col, fresh_units, fresh_nodes = [], [], [], [], []
        first_open = np.zeros(n)
        from_ = np.zeros(n, np.int64)
        for t, p in enumerate(paths):
            mine = alive[owner[alive] == t]
            if not len(mine):
                continue
            w = where[mine]
            here = p["node"][w]
            open_ = lattice.chance[here].astype(np.float64)
            for other in paths:
                # every path that passes this node with the same choices before it has taken its own choice
                self_same = _same_prefix(p, w, other, mine)
                good = self_same >= 0
                open_[np.flatnonzero(good), other["col"][self_same[good]]] = 0
            total = open_.sum(axis=1)
            u = _uniform(splitmix(seeds[mine] + np.uint64(turn + 77)) + w.astype(np.uint64) - p["cut"][mine].astype(np.uint64)) * total
            c = (np.cumsum(open_, axis=1) < u[:, None]).sum(axis=1)
            c = np.where(open_[np.arange(len(mine)), np.minimum(c, open_.shape[1] - 1)] > 0, np.minimum(c, open_.shape[1] - 1), open_.argmax(axis=1))
            open_[np.arange(len(mine)), c] = 0
            first_open[mine] = open_.sum(axis=1)
            from_[mine] = w - p["cut"][mine]
            p["bound"][w] = -np.inf
            size = w - p["cut"][mine]
            at = _ranges(p["cut"][mine], size)
            new_unit += [p["unit"][at], p["unit"][w]]
            new_node += [p["node"][at], here]
            new_col += [p["col"][at], c]
            fresh_units.append(p["unit"][w])
            fresh_nodes.append(here + c + 1)
            later = bounds[1:][mine] - p["unit"][w] - 1
            rest = _ranges(p["unit"][w] + 1, later)
            fresh_units.append(rest)
            fresh_nodes.append(unit_node[rest])
        fu, fn = np.concatenate(fresh_units), np.concatenate(fresh_nodes)
        more = walk(fu, fn, 3 + turn)
        unit, node, col = (np.concatenate([*a, b]) for a, b in zip((new_unit, new_node, new_col), more))
        # what was kept of a unit comes before what is new in it
        order = np.argsort(unit, kind="stable")
        unit, node, col = unit[order], node[order], col[order]
        value = np.where(np.isin(np.arange(n), alive), best, -np.inf)

    out: list[list[tuple[np.ndarray, float, float]]] = []
    flat = [_ids(lattice, p["node"], p["col"]) for p in paths]
    for d in range(n):
        if bounds[d] == bounds[d + 1]:
            out.append([(np.zeros(0, np.int32), 0.0, 1.0)])
            continue
        made = []
        for turn, logp in answers[d]:
            ids, at = flat[turn]
            a, b = paths[turn]["cut"][d], paths[turn]["cut"][d + 1]
            inclusion = -np.expm1(-np.exp(min(logp - kappa[d], 50.0))) if np.isfinite(kappa[d]) else 1.0
            made.append((ids[at[a] : at[b]], logp, float(inclusion)))
        out.append(made)
    return out


def _same_prefix(p: dict, w: np.ndarray, other: dict, docs: np.ndarray) -> np.ndarray:
    """For choice w of each text on path p: the place of the choice at the same node on ``other`` after the same choices, or -1."""
    place = w - p["cut"][docs]
    at = other["cut"][docs] + place
    ok = at < other["cut"][docs + 1]
    at = np.where(ok, at, 0)
    ok &= (other["node"][at] == p["node"][w]) & (other["unit"][at] == p["unit"][w])
    if other is not p:
        for i in np.flatnonzero(ok):
            a, b, m = p["cut"][docs[i]], other["cut"][docs[i]], place[i]
            ok[i] = np.array_equal(p["col"][a : a + m], other["col"][b : b + m])
    return np.where(ok, at, -1)


def _ids(lattice: Lattice, node: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of choices, byte pieces spelt out, and where each choice's ids begin."""
    v = lattice.v
    entry = lattice.entry[node, col]
    ids = np.where(entry >= 0, v.ids[np.maximum(entry, 0)], -1).astype(np.int32)
    bare = np.flatnonzero(entry < 0)
    if not len(bare):
        return ids, np.arange(len(ids) + 1)
    spelt = [(chr(MARK) if q == OWN_MARK else chr(q)).encode("utf-8", "surrogatepass") for q in lattice.points[node[bare]]]
    sizes = np.ones(len(ids), np.int64)
    sizes[bare] = [len(b) for b in spelt]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(ids, sizes)
    out[_ranges(at[:-1][bare], sizes[bare])] = v.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
    return out, at


def decode(ids, v: Vocabulary) -> str:
    """The text of a sequence of piece ids; control pieces decode to nothing."""
    text = b"".join([v.bytes_of[i] for i in ids])
    return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


def segmentations(documents: DataFrame, path: str = DEFAULT_MODEL, k: int = 2, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(key, rank, ids, n_pieces, log_prob, inclusion, round_trip): up to k rows for each row of ``documents``.

    A null or empty text has one segmentation, of no pieces, with log_prob 0 and inclusion 1; a text with fewer than k
    segmentations has all of them. round_trip says that decoding gives the text back. Equal keys and texts give equal
    samples. ``path`` names the model file on each executor.
    """
    kept = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("_seed"))

    def run(source):
        v = vocabulary(path)
        for batch in batches(source, BATCH):
            texts = batch.column("text").to_pylist()
            found = sample(texts, np.asarray(batch.column("_seed")).view(np.uint64), v, k)
            rows = [(i, r, *s) for i, made in enumerate(found) for r, s in enumerate(made)]
            ids = [x[2] for x in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            good = [decode(x.tolist(), v) == texts[i] for (i, *_), x in zip(rows, ids)]
            which = pa.array([x[0] for x in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(which), pa.array([x[1] for x in rows], pa.int32()), lists, pa.array(np.diff(offsets)), pa.array([x[3] for x in rows]), pa.array([x[4] for x in rows]), pa.array(good)],
                names=["doc_id", "rank", "ids", "n_pieces", "log_prob", "inclusion", "round_trip"],
            )

    more = "rank int, ids array<int>, n_pieces int, log_prob double, inclusion double, round_trip boolean"
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *T._parse_datatype_string(more).fields]))
