"""A character-level bidirectional LSTM with CRF transitions in numpy: training, window emissions and global decoding.

Gates are the piecewise linear ones (a quarter of the input plus a half, cut to [0, 1]; cells cut to [-1, 1]), which cost a
tenth of exponentials, so that whole texts can be read.
"""

from __future__ import annotations

import numpy as np

TRAIN_WINDOW = 96
WINDOW, STRIDE, GRAIN = 512, 480, 32
TOGETHER = 256  # windows that run in step
NEVER = 1e4  # what a tag other than outside loses where there is no text
SYMBOLS = 130  # 0 pads, 1-128 are ASCII, 129 is any other character


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 1, 129).astype(np.uint8)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _slope(gate: np.ndarray) -> np.ndarray:
    return 0.25 * ((gate > 0) & (gate < 1))


def _open(cell: np.ndarray) -> np.ndarray:
    return np.abs(cell) < 1


class Tagger:
    """Parameters in one dict of float32 arrays; tag 0 is outside, 2k + 1 begins and 2k + 2 continues kind k."""

    def __init__(self, kinds: int, hidden: int = 12, embed: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 2 * kinds + 1, hidden
        w = lambda *shape, scale=0.2: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": w(SYMBOLS, embed, scale=0.5)}
        for d in "fb":
            self.p |= {f"{d}x": w(embed, 4 * hidden), f"{d}h": w(hidden, 4 * hidden), f"{d}b": np.zeros(4 * hidden, np.float32)}
            self.p[f"{d}b"][hidden : 2 * hidden] = 1
        self.p |= {"O": w(2 * hidden, self.tags), "o": np.zeros(self.tags, np.float32), "A": np.zeros((self.tags, self.tags), np.float32)}
        # a continuation needs its own kind before it
        self.banned = np.zeros((self.tags, self.tags), np.float32)
        for t in range(2, self.tags, 2):
            self.banned[[u for u in range(self.tags) if u not in (t, t - 1)], t] = -1e4
        self.first = np.where(np.arange(self.tags) % 2 == 0, -1e4, 0).astype(np.float32)
        self.first[0] = 0

    # ------------------------------------------------------------ forward
    def _run(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        H = self.hidden
        gates = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        out = np.empty((n, steps, H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[:, t] + h @ self.p[f"{d}h"]
            i, f, o = _gate(z[:, :H]), _gate(z[:, H : 2 * H]), _gate(z[:, 2 * H : 3 * H])
            g = np.clip(z[:, 3 * H :], -1, 1)
            before = c
            c = f * c + i * g
            th = np.clip(c, -1, 1)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, th))
            h = o * th
            out[:, t] = h
        return out

    def emissions(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, steps, tags) of the forward and of the backward direction, the latter from each window's end on.

        Windows of symbols come by falling length, in multiples of GRAIN. All run together, each from its own first and
        last symbol on, and those that end drop out. What a symbol adds to the gates comes of the same product as the state.
        """
        n, steps = windows.shape
        H = self.hidden
        scale = np.full((4 * H, 1), 0.25, np.float32)
        scale[3 * H :] = 1
        shift = np.full((4 * H, 1), 0.5, np.float32)
        shift[3 * H :] = 0
        # the state, the symbol and a one
        product = np.stack([np.hstack([self.p[f"{d}h"].T * scale, self.p[f"{d}x"].T * scale, self.p[f"{d}b"][:, None] * scale + shift]) for d in "fb"])
        symbol = np.hstack([self.p["E"], np.ones((SYMBOLS, 1), np.float32)])
        said = [np.ascontiguousarray(self.p["O"][half].T) for half in (slice(H), slice(H, None))]
        out = np.zeros((2, n, steps, self.tags), np.float32)
        c, last, live = np.zeros((2, H, n), np.float32), np.zeros((2, H, n), np.float32), -1
        for at in range(0, steps, GRAIN):
            m = int((lengths > at).sum())
            if m != live:
                live = m
                c = np.ascontiguousarray(c[:, :, :m])
                taken = np.empty((GRAIN + 1, 2, product.shape[2], m), np.float32)
                z = np.empty((2, 4 * H, m), np.float32)
                # bounds as arrays: numpy compares with a number several times slower
                low, high = np.zeros_like(z), np.ones_like(z)
                low[:, 3 * H :] = -1
            ahead = at + np.arange(GRAIN)[:, None]
            taken[0, :, :H] = last[:, :, :m]
            taken[:GRAIN, 0, H:] = symbol.take(windows[:m, at : at + GRAIN].T, axis=0).transpose(0, 2, 1)
            taken[:GRAIN, 1, H:] = symbol.take(windows[np.arange(m), lengths[:m] - 1 - ahead], axis=0).transpose(0, 2, 1)
            i, f, o, g = (z[:, k * H : (k + 1) * H] for k in range(4))
            for t in range(GRAIN):
                np.matmul(product, taken[t], out=z)
                np.maximum(z, low, out=z)
                np.minimum(z, high, out=z)
                g *= i
                c *= f
                c += g
                h = taken[t + 1, :, :H]
                np.maximum(c, low[:, 3 * H :], out=h)
                np.minimum(h, high[:, 3 * H :], out=h)
                h *= o
            last = taken[GRAIN, :, :H]
            for d in (0, 1):
                out[d, :m, at : at + GRAIN] = (said[d] @ taken[1:, d, :H]).transpose(2, 0, 1)
        return out[0], out[1]

    # ------------------------------------------------------------ training
    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood, and its gradients by emissions and transitions."""
        n, steps, k = e.shape
        A = self.p["A"] + self.banned
        up, down = np.empty_like(e), np.zeros_like(e)
        up[:, 0] = e[:, 0] + self.first
        for t in range(1, steps):
            z = up[:, t - 1, :, None] + A
            m = z.max(axis=1)
            up[:, t] = m + np.log(np.exp(z - m[:, None]).sum(axis=1)) + e[:, t]
        for t in range(steps - 2, -1, -1):
            z = A + (e[:, t + 1] + down[:, t + 1])[:, None, :]
            m = z.max(axis=2)
            down[:, t] = m + np.log(np.exp(z - m[:, :, None]).sum(axis=2))
        m = up[:, -1].max(axis=1)
        total = m + np.log(np.exp(up[:, -1] - m[:, None]).sum(axis=1))
        de = np.exp(up + down - total[:, None, None])
        gold = np.take_along_axis(e, y[:, :, None], 2).sum(axis=(1, 2)) + A[y[:, :-1], y[:, 1:]].sum(axis=1)
        dA = np.zeros((k, k))
        for t in range(1, steps):
            pair = up[:, t - 1, :, None] + A + (e[:, t] + down[:, t])[:, None, :] - total[:, None, None]
            dA += np.exp(pair).sum(axis=0)
        np.subtract.at(dA, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        return float((total - gold).mean()), de / n, (dA / n).astype(np.float32)

    def _gradients(self, chars: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x = self.p["E"][chars]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, kept[d]) for d in "fb"], axis=2)
        loss, de, dA = self._crf(both @ self.p["O"] + self.p["o"], y)
        H, n = self.hidden, len(chars)
        grads = {"A": dA, "O": np.einsum("nth,ntk->hk", both, de), "o": de.sum(axis=(0, 1))}
        dboth = de @ self.p["O"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :H]), ("b", dboth[:, :, H:])):
            U, gates = self.p[f"{d}h"], np.zeros((n, chars.shape[1], 4 * H), np.float32)
            dU, dh, dc = np.zeros_like(U), np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
            for t, h, before, i, f, o, g, th in reversed(kept[d]):
                dh = dh + part[:, t]
                dc = dc + dh * o * _open(th)
                z = np.concatenate([dc * g * _slope(i), dc * before * _slope(f), dh * th * _slope(o), dc * i * _open(g)], axis=1)
                gates[:, t] = z
                dU += h.T @ z
                dh, dc = z @ U.T, dc * f
            grads |= {f"{d}h": dU, f"{d}b": gates.sum(axis=(0, 1)), f"{d}x": np.einsum("nte,ntg->eg", x, gates)}
            dx += gates @ self.p[f"{d}x"].T
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], chars.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, grads

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 96, rate: float = 0.02, seed: int = 3) -> float:
        """Adam over shuffled batches with a falling rate; returns the mean loss of the last epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total, last = 0, epochs * -(-len(chars) // batch), 0.0
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(chars))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, grads = self._gradients(chars[pick], tags[pick])
                losses.append(loss)
                step += 1
                now = rate * (1 - (step - 1) / total)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.005 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    # ------------------------------------------------------------ decoding
    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tags) of all texts one after the other, each with a row of no text behind it, and where they begin.

        Emissions of overlapping windows are averaged with most weight on a window's middle.
        """
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        weight = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)
        sums, loads = np.zeros((begins[-1], self.tags), np.float32), np.zeros(begins[-1], np.float32)
        # a text's last window is only as long as what is left of it, rounded up, whatever stands beside it
        every = [(-(-min(WINDOW, len(x) - a) // GRAIN) * GRAIN, k, a) for k, x in enumerate(texts) if len(x) for a in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)]
        every.sort(key=lambda w: -w[0])
        for at in range(0, len(every), TOGETHER):
            part = every[at : at + TOGETHER]
            windows = np.zeros((len(part), part[0][0]), np.uint8)
            for i, (_, k, a) in enumerate(part):
                piece = texts[k][a : a + WINDOW]
                windows[i, : len(piece)] = piece
            ahead, back = self.emissions(windows, np.array([steps for steps, _, _ in part]))
            for i, (steps, k, a) in enumerate(part):
                m, to = min(WINDOW, len(texts[k]) - a), begins[k] + a
                e = ahead[i, :m] + back[i, steps - m : steps][::-1]
                e += self.p["o"]
                e *= weight[:m, None]
                sums[to : to + m] += e
                loads[to : to + m] += weight[:m]
        sums /= np.maximum(loads, 1)[:, None]
        sums[begins[1:] - 1, 1:] = -NEVER
        return sums, begins

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each text, by one Viterbi search over the whole of it, which settles all its windows together.

        Most places can't be in any span of the best tags: a span that loses to plain outside tags, whatever stands beside
        it, is in none. Such places are outside without a search; between them stretches are searched alone, which
        gives the same tags. Takes about 150 bytes a character.
        """
        e, begins = self.scores(texts)
        tags = np.zeros(len(e), np.int8)
        stretches = sorted(self._stretches(e), key=lambda ab: ab[1] - ab[0])
        at = 0
        while at < len(stretches):
            # stretches of similar length go together
            to = at + 1
            while to < len(stretches) and (to - at) * (stretches[to][1] - stretches[to][0]) < 1 << 15:
                to += 1
            group = stretches[at:to]
            for (a, b), found in zip(group, self._viterbi([e[a:b] for a, b in group])):
                tags[a:b] = found
            at = to
        return [tags[a : b - 1] for a, b in zip(begins[:-1], begins[1:])]

    def _stretches(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Where spans of the best tags can lie: for each start the farthest end at which a span still gains over outside tags."""
        n = len(e)
        A = self.p["A"].astype(np.float64)
        outer = [0, *range(1, self.tags, 2)]  # what a tag outside of a span's inside may be
        by_tag = np.ascontiguousarray(e.T)
        by_tag[1:] -= by_tag[0]
        found = []
        for b in range(1, self.tags, 2):
            i = b + 1
            # the most that borders can give, and that the first step inside can give beyond later ones
            border = max(A[y, b] - A[y, 0] for y in range(self.tags)) + max(A[x, y] - A[0, y] for x in (b, i) for y in outer) + max(0.0, A[b, i] - A[i, i])
            run = np.cumsum(by_tag[i] + np.float32(A[i, i] - A[0, 0]), dtype=np.float64)
            ahead = np.maximum.accumulate(run[::-1])[::-1]
            # rounding of the sums may lose one part in ten million
            enough = border + 1e-5 + 1e-7 * max(abs(run.max(initial=0)), abs(run.min(initial=0)))
            for a in np.flatnonzero(ahead - run + by_tag[b] >= -enough):
                need = run[a] - by_tag[b, a] - enough
                # sums ahead only fall, so the last place that reaches it is found by halves
                lo, hi = int(a), n
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if ahead[mid] >= need else (lo, mid)
                found.append((int(a), lo + 1))
        out: list[list[int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of stretches or whole texts, each between two outside tags."""
        lengths = np.array([len(x) for x in scores])
        n, steps, k = len(scores), int(lengths.max()), self.tags
        e = np.zeros((steps, n, k), np.float32)
        for i, x in enumerate(scores):
            e[: len(x), i] = x
        into = np.ascontiguousarray((self.p["A"] + self.banned).T)
        back = np.zeros((steps, n, k), np.int8)
        score = e[0] + self.first + self.p["A"][0]
        final = score.copy()
        for t in range(1, steps):
            z = score[:, None, :] + into
            best = z.argmax(axis=2)
            back[t] = best
            score = np.take_along_axis(z, best[:, :, None], 2)[:, :, 0] + e[t]
            done = lengths == t + 1
            if done.any():
                final[done] = score[done]
        last = (final + into[0]).argmax(axis=1)
        tags = np.zeros((steps, n), np.int8)
        now, line = np.zeros(n, np.int64), np.arange(n)
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps:
                now = back[t + 1, line, now].astype(np.int64)
            now = np.where(lengths == t + 1, last, now)
            tags[t] = now
        return [tags[: lengths[i], i] for i in range(n)]
