"""HTML extraction by the maximum-scoring subsequence: words score positive and tags negative.

A page is a sequence of tags and words. Each tag and each kind of word has a weight, the log-odds of standing in the main
text of labelled pages, less a constant; a linear scan finds the contiguous run of the largest sum. Pages label
themselves where their author marked exactly one ``article`` or ``main``: what it holds counts as main text, so weights
come from a bounded sample of such pages. Such a mark is also a feature of a page's own words, of bounded weight. Scripts, styles and the like never count as words, and boilerplate sections
inside the run (menus, asides, forms, notices, comments ...) are left out of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

# fixed values: elements of the HTML standard by how they behave
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
UNSEEN = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "head", "title", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist", "button", "textarea"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# words of class, id and role attributes that mark what is not the article
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w+|signup|popup|modal|overlay|comments?|commentlist|disqus|respond|repl(?:y|ies)|discussion|sidebar|aside|widget|related|recommend\w*|more-?stories|share|sharing|social|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|header|site-?header|footer|site-?footer|copyright|legal|login|search|form|complementary|contentinfo|dialog|skip-?link|tags?)(?=$|[\s_-])",
    re.I,
)
KEEP = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body)(?:[_-](?:header|title|body|content|text))?(?=$|\s)", re.I)

# elements that are neither listed above nor invented by an author
BLOCK = set("address article blockquote body caption center col colgroup dd details dir div dl dt figcaption figure frame frameset h1 h2 h3 h4 h5 h6 hgroup html legend li main meter ol optgroup option output p picture pre progress search section slot summary table tbody td tfoot th thead tr ul".split())
KNOWN = RAW | UNSEEN | BOILERPLATE | INLINE | VOID | BLOCK

# A tag ends at the first > outside of quotes, and a quote opens after an equals sign only. A < before that > makes its own <
# plain text. All repeats are possessive, so that nothing is read again and the time is linear in the page.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?+)([a-zA-Z][^\s/<>]*+)((?>[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>",
    re.S,
)
# an unquoted value may end with a slash of its own
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLANK = re.compile(r"\s+")


@dataclass
class Page:
    """Per token: its kind, the text of a run of words (None for a tag), whether a skipped block holds it, and how many marked elements hold it."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    skip: list[bool] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    marked: int = 0


def parse(source: str) -> Page:
    """Tokens of a page in order; every character is read once. Unclosed and stray tags are tolerated."""
    page, at, stack, unseen, boiler, main = Page(), 0, [], 0, 0, 0

    def text(piece: str) -> None:
        if piece and not unseen:
            kind = "link word" if "a" in names else "word"
            page.kinds.append(kind)
            page.texts.append(entities.unescape(piece))
            page.skip.append(boiler > 0)
            page.inside.append(main)

    names: Counter = Counter()
    while True:
        found = PIECE.search(source, at)
        if not found:
            text(source[at:])
            return page
        text(source[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        page.kinds.append(("/" if closing else "") + name)
        page.texts.append(None)
        page.skip.append(boiler > 0)
        page.inside.append(main)
        if closing:
            # a stray end closes nothing; any other closes all that was opened after its start
            while names.get(name):
                last, u, b, m = stack.pop()
                names[last] -= 1
                if not names[last]:
                    del names[last]
                unseen, boiler, main = unseen - u, boiler - b, main - m
                if last == name:
                    break
        elif name not in VOID and not SELF_CLOSED.search(found[3], max(0, len(found[3]) - 64)):
            hidden = said = ""
            for a in ATTRIBUTE.finditer(found[3]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "hidden" or a[1].lower() == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = "yes"
                elif a[1].lower() in ("class", "id", "role"):
                    said += " " + value
            u = name in UNSEEN or bool(hidden)
            inner_header = name == "header" and main > 0
            b = (name in BOILERPLATE and not inner_header) or (bool(MARKS.search(said)) and not KEEP.search(said) and name not in ("html", "body", "main", "article"))
            m = name in ("article", "main") and not boiler and not b
            page.marked += m and not main
            stack.append((name, u, b, m))
            names[name] += 1
            unseen, boiler, main = unseen + u, boiler + b, main + m
            page.skip[-1] = boiler > 0
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                at = end.start() if end else len(source)


OTHER_TAG = "other tag"


@dataclass(frozen=True)
class Weights:
    """score of each kind of token; a word token of n words scores n times."""

    of: dict[str, float]

    def score(self, kind: str, words: int) -> float:
        if words >= 0:
            return self.of[kind] * words
        return self.of.get(kind, self.of[OTHER_TAG])


MARK, INNER = 3.5, 8.0
DEFAULT = Weights({"word": 1.0, "link word": -1.0, OTHER_TAG: -2.0})


def tally(page: Page) -> Counter:
    """How often each kind of token stands inside and outside the marked main text; nothing if the page isn't marked once."""
    out: Counter = Counter()
    if page.marked == 1:
        for kind, text, skip, inside in zip(page.kinds, page.texts, page.skip, page.inside):
            if text is None and kind.lstrip("/") not in KNOWN:
                kind = OTHER_TAG  # an author may invent names without end
            out[kind, bool(inside) and (text is None or not skip)] += 1 if text is None else len(text.split())
    return out


def weigh(counts: Counter) -> Weights:
    """Log-odds with a pseudo-count of 2, cut to a few units; words are kept positive, tags negative, as the method asks."""
    if not counts:
        return DEFAULT
    totals = {side: sum(v for (_, s), v in counts.items() if s is side) + 1 for side in (True, False)}
    weights = {OTHER_TAG: -2.0}
    for kind in {k for k, _ in counts} | {"word", "link word"}:
        odds = np.log((counts[kind, True] + 2) / totals[True]) - np.log((counts[kind, False] + 2) / totals[False])
        if kind == "word":
            weights[kind] = float(np.clip(odds, 0.25, 3))
        elif kind == "link word":
            weights[kind] = float(np.clip(odds, -3, 1))
        else:
            weights[kind] = float(np.clip(odds, -2, -0.05))
    return Weights(weights)


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Bounds of the contiguous run of the largest sum, (0, 0) if no sum is positive; of equal ones the first, then longest."""
    if not len(scores):
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(total)
    gain = total[1:] - lowest[:-1]
    best = gain.max()
    if best <= 1e-9:
        return 0, 0
    end = int(np.flatnonzero(gain >= best - 1e-9)[0]) + 1
    start = int(np.flatnonzero(total[:end] <= lowest[end - 1] + 1e-9)[0])
    return start, end


def scores_of(page: Page, weights: Weights) -> np.ndarray:
    """Score of each token. What a skipped block holds is left out of the text in any case and scores 0, so that it can't cut an article in two.

    An author's single mark is one more feature: words inside gain MARK each and words outside lose it, and tags inside, of
    lists and links for example, count for less. The scan still weighs it against everything else.
    """
    scores = np.zeros(len(page.kinds))
    marked = page.marked == 1
    for i, (kind, text, skip, inside) in enumerate(zip(page.kinds, page.texts, page.skip, page.inside)):
        if skip:
            continue
        n = -1 if text is None else len(text.split())
        score = weights.score(kind, n)
        if marked and n >= 0:
            score += MARK * n if inside else -MARK * n
        elif marked and inside:
            score /= INNER
        scores[i] = score
    return scores


def main_text(page: Page, weights: Weights) -> str:
    """The text of the best run: blocks in page order joined by a space, white space within a block as one space."""
    start, end = best_run(scores_of(page, weights))
    blocks, now = [], []
    for i in range(start, end):
        if page.texts[i] is None:
            if page.kinds[i].lstrip("/") not in INLINE:
                blocks.append("".join(now))
                now = []
        elif not page.skip[i]:
            now.append(page.texts[i])
    blocks.append("".join(now))
    return " ".join(b for b in (BLANK.sub(" ", x).strip() for x in blocks) if b)


def learn(pages: DataFrame, html: str = "html", most: int = 2048) -> Weights:
    """Weights from the pages of the ``most`` least hashes (equal pages have one hash) that mark their main text themselves."""
    hashed = pages.where(F.col(html).isNotNull()).select(html, F.xxhash64(html).alias("_k"))
    # the hashes alone find the bound, so that no task gathers pages
    bound = hashed.select("_k").orderBy("_k").limit(most).agg(F.max("_k")).first()[0]
    sample = hashed.where(F.col("_k") <= bound) if bound is not None else hashed.limit(0)

    def run(source):
        counts: Counter = Counter()
        for batch in source:
            for text in batch.column(html).to_pylist():
                counts.update(tally(parse(text)))
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([s for _, s in keys]), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "side", "n"])

    rows = sample.select(html).mapInArrow(run, "kind string, side boolean, n long").groupBy("kind", "side").agg(F.sum("n").alias("n"))
    # at most two rows for each element of the standard, opened and closed
    return weigh(Counter({(r.kind, r.side): r.n for r in rows.collect()}))


def extract(pages: DataFrame, weights: Weights, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of ``html``; empty for a null or empty page and for one without words."""
    names = [c for c in pages.columns if c not in (html, out)]
    kept = pages.select(*names, html)

    def run(source):
        for batch in batches(source):
            texts = [main_text(parse(h), weights) if h else "" for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

    fields = [f for f in kept.schema.fields if f.name != html]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; repeated pages give equal texts."""
    found = extract(pages.select("page_id", "url", "html"), learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
