"""Personal data: fixed patterns, and a character LSTM with CRF transitions that adds spans which the patterns miss.

The tagger learned from labelled spans: generated sentences with addresses, numbers and look-alikes (keys, versions,
dates, prices). Its weights lie beside this module, so that they are the same on every machine; ``train`` made them, and
makes others from a caller's spans. It reads whole texts in overlapping windows, settled by one decoding over each text.
A span of the tagger is set to the borders of its words and stays if it has the digits or parts that its kind can't do
without, and overlaps no span of the patterns.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches
from .lstm_crf import TRAIN_WINDOW, Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
# an address around its sign: what the local part holds, and how the domain goes on
SIGN = re.compile(r"@| ?[\[({] ?at ?[\])}] ?", re.I)
NAME = re.compile(r"[\w.%+-]")
HOST = re.compile(r"[\w-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[\w-]+)*", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and without overlap within a kind, by start and kind. Time is linear in the text."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        run = text[max(end, at - 1) : at]
        if run and run in LOCAL:
            lo = end
            size = 64
            while True:  # the run of local characters before the sign, looked for in growing steps
                piece = text[max(lo, at - size) : at]
                kept = len(piece) - len(piece.rstrip(LOCAL))
                if kept < len(piece) or at - size <= lo:
                    break
                size *= 4
            domain = DOMAIN.match(text, at + 1)
            if kept and domain:
                found.append(("email", at - kept, domain.end()))
                end = domain.end()
        at = text.find("@", max(at + 1, end))
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP.finditer(run[0]):
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                    found.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- labelled spans
def generated(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences with labelled spans, and look-alikes that carry none."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk" + "éèàüößñç"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 10)))
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    plain = lambda k: "".join(r.choices(letters[:22], k=k))

    def email() -> str:
        name = r.choice([plain(r.randint(3, 9)), plain(6) + "." + digits(2), plain(4) + "_" + plain(4), plain(1) + digits(3), plain(5) + "." + plain(5)])
        host = r.choice([plain(5), "mail" + digits(1), "mail" + digits(1) + "." + plain(7)])
        last = r.choice(["com", "org", "net", "de", "co.uk", "example.com"])
        sign, dot = r.choice([("@", ".")] * 6 + [(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", ".")])
        return name + sign + host.replace(".", dot) + dot + last.replace(".", dot)

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        return r.choice([digits(16)] * 5 + [digits(13), digits(15), digits(14), digits(19), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(4) + " " + digits(6) + " " + digits(5)])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(2)} {a} {digits(7)}", f"{a}.{b}.{c}"])

    def decoy() -> str:
        hexed = lambda k: "".join(r.choices("0123456789abcdef", k=k))
        return r.choice(
            [
                lambda: f'token = "{hexed(40)}"', lambda: hexed(r.choice([16, 32, 40, 64])), lambda: "key=" + hexed(24), lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"version {r.randint(1, 9)}.",
                lambda: f"CC BY-NC {r.randint(1, 4)}.0.", lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"${r.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: digits(r.randint(1, 6)), lambda: f"{r.randint(1, 9)}.{digits(3)}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
                lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(0, 99)}.{digits(3)}", lambda: digits(r.randint(21, 40)), lambda: "@" + plain(6), lambda: f"{word()} @ {word()}", lambda: f"{r.choice('ABCDEFG')}{digits(5)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)}-{digits(1)}", lambda: f"pages {digits(2)}-{digits(3)}", lambda: plain(4) + digits(4), lambda: f"§ {digits(2)}.{digits(1)}", lambda: f"https://www.{plain(6)}.org/{digits(4)}",
            ]
        )()

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        joint = r.choice([" "] * 8 + ["!! ", "%%% ", " | "])
        for _ in range(r.randint(3, 9)):
            pick = r.random()
            if pick < 0.32:
                kind = r.choice(KINDS)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            elif pick < 0.5:
                text += decoy()
            else:
                text += r.choice([word, word, lambda: word().capitalize(), lambda: word().upper()])()
            text += r.choice([joint] * 9 + [", ", ". ", ".\n"])
        out.append((text, spans))
    return out


def windows_of(labelled: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    chars, tags = [], []
    for text, spans in labelled:
        s, y = symbols(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            y[a:b] = 2 * k + 2
            y[a] = 2 * k + 1
        for at in range(0, max(1, len(s) - TRAIN_WINDOW // 2), TRAIN_WINDOW):
            # a window that begins within a span can't know its beginning; decoding never starts there either
            while at and y[at] and y[at] % 2 == 0:
                at -= 1
            c, z = np.zeros(TRAIN_WINDOW, np.int64), np.zeros(TRAIN_WINDOW, np.int64)
            c[: len(s[at : at + TRAIN_WINDOW])] = s[at : at + TRAIN_WINDOW]
            z[: len(y[at : at + TRAIN_WINDOW])] = y[at : at + TRAIN_WINDOW]
            chars.append(c)
            tags.append(z)
    return np.array(chars), np.array(tags)


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.json")


def train(labelled: list[tuple[str, list[Span]]], epochs: int = 9, start: Tagger | None = None) -> Tagger:
    """A tagger for labelled spans; from ``start`` on where one is given."""
    tagger = start or Tagger(len(KINDS))
    tagger.fit(*windows_of(labelled), epochs=epochs)
    return tagger


def save(tagger: Tagger, path: str = WEIGHTS) -> None:
    """Weights to five decimals, one line for each array."""
    with open(path, "w", encoding="ascii") as f:
        rows = [f'"{name}": {json.dumps([list(x.shape), [round(float(v), 5) for v in x.ravel()]])}' for name, x in tagger.p.items()]
        f.write("{\n" + ",\n".join(rows) + "\n}\n")


@lru_cache(maxsize=1)
def shipped() -> Tagger:
    """The tagger whose weights lie beside this module: ``python -m corpusloom.llm.pii`` trains and writes them."""
    tagger = Tagger(len(KINDS))
    with open(WEIGHTS, encoding="ascii") as f:
        tagger.p = {name: np.array(x, np.float32).reshape(shape) for name, (shape, x) in json.load(f).items()}
    return tagger


# ---------------------------------------------------------------- spans of the tagger
def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """How far an address reaches around its sign at (a, b); no two signs share a part of a side, so the time is linear."""
    while a > 0 and NAME.match(text, a - 1):
        a -= 1
    host = HOST.match(text, b)
    return a, host.end() if host else b


def _settled(text: str, kind: str, a: int, b: int) -> Span | None:
    """The span without blanks at its ends and with whole numbers, or none if it lacks what its kind has."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    inside = lambda c: "0" <= c <= "9"
    if kind != "email":
        while a > 0 and a < b and inside(text[a]) and inside(text[a - 1]):
            a -= 1
        while b < len(text) and b > a and inside(text[b - 1]) and inside(text[b]):
            b += 1
        if a and text[a].isalnum() and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
            return None
    elif sign := SIGN.search(text, a, b):
        a, b = _around(text, *sign.span())
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
    part = text[a:b]
    digits = len(NOT_DIGIT.sub("", part))
    numbers = [p for p in NOT_DIGIT.split(part) if p]
    fits = {
        "email": lambda: bool(SIGN.search(part)) and a < b and bool(re.search(r"\.|dot", part[SIGN.search(part).end() :], re.I)),
        "ip": lambda: len(numbers) == 4 and part.count(".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in numbers),
        "card": lambda: 12 <= digits <= 19 and digits >= 0.6 * len(part),
        "phone": lambda: 7 <= digits <= 15 and digits >= 0.5 * len(part) and len(numbers) > 1,
    }[kind]()
    return (kind, a, b) if fits else None


def learned_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    found: list[list[Span]] = [[] for _ in texts]
    for i, tags in enumerate(tagger.decode([symbols(t) for t in texts])):
        for s in np.flatnonzero(tags % 2 == 1):
            k, e = (tags[s] - 1) // 2, s + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            span = _settled(texts[i], KINDS[k], int(s), int(e))
            if span:
                found[i].append(span)
    return found


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) for each text: base spans stay, learned ones are added where they overlap none before them."""
    out = []
    for text, learned in zip(texts, learned_spans(texts, tagger)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        more, last = [], -1
        at = 0
        for span in sorted(set(learned), key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
            while at < len(taken) and taken[at][1] <= span[1]:
                at += 1
            clear = all(b <= span[1] or a >= span[2] for a, b in taken[max(0, at - 4) : at + 4])
            if clear and span[1] >= last:
                more.append(span)
                last = span[2]
        out.append((base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- operators
BATCH = 1 << 18
REMEMBERED = 1 << 15


def _tagged(documents: DataFrame, tagger: Tagger, produce, fields: list[T.StructField], names: list[str]) -> DataFrame:
    """Runs ``produce(text, base, all)`` for each row."""
    weights = documents.sparkSession.sparkContext.broadcast(tagger)
    kept = documents.select(*names, "text")

    def run(source):
        model, known = weights.value, {}
        for batch in batches(source, BATCH):
            texts = batch.column("text").to_pylist()
            # copies within a task are read once, as far as a bounded memory goes
            marks = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            new = {k: t or "" for k, t in zip(marks, texts) if k not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {k: t or "" for k, t in zip(marks, texts)}
            known.update(zip(new, all_spans(list(new.values()), model)))
            made = [produce(t, *known[k]) for k, t in zip(marks, texts)]
            arrays = [pa.array(list(v), pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for v, f in zip(zip(*made), fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *(f.name for f in fields)])

    return kept.mapInArrow(run, T.StructType([*(kept.schema[n] for n in names), *fields]))


def find(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added, for every row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans, whose digest is that of the empty text.
    Repeated rows have equal results; an empty table gives an empty one.
    """

    def produce(text, base, every):
        count = {k: 0 for k in KINDS}
        for k, _, _ in base:
            count[k] += 1
        return (*count.values(), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base))

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return _tagged(documents, tagger or shipped(), produce, fields, ["doc_id"])


def redact(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``documents`` with every found span of ``text`` replaced; other columns, their order and null texts stay."""
    names = [c for c in documents.columns if c != "text"]
    done = _tagged(documents, tagger or shipped(), lambda t, base, every: (redacted(t, every) if every else t,), [T.StructField("text", T.StringType())], names)
    return done.select(*documents.columns)


if __name__ == "__main__":
    # how the weights beside this module were made
    save(train(generated(10_000), epochs=9))
