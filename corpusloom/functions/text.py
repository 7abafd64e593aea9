"""Text expressions: white space, the six tokenizers, sentences, choices, prompts' clean-up and digests.

All are built-in expressions. Case folding is ``lower`` plus sharp s, which equals full folding on Latin text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what each tokenizer takes as a token or a gap, and where a sentence ends
SPACES = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
CHECK_TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)*"
BOUNDARY = r"""(?<=[.!?])["')\]]*\s+(?=[A-Z0-9"'(\[])"""


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often and in whatever lambda ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def folded(c: Column) -> Column:
    return F.replace(F.lower(text_of(c)), F.lit("ß"), F.lit("ss"))


def collapsed(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), SPACES, " "))


def words(c: Column) -> Column:
    """Runs without white space, in order."""
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def word_set(c: Column) -> Column:
    """Distinct folded word-character runs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(WORD), F.lit(0)), folded))


def check_tokens(c: Column) -> Column:
    """Folded ASCII tokens with inner apostrophes; other letters separate."""
    return F.regexp_extract_all(folded(c), F.lit(CHECK_TOKEN), F.lit(0))


def spaced_key(c: Column) -> Column:
    """Folded text with everything but word characters as single spaces."""
    return F.trim(F.regexp_replace(folded(c), NOT_WORD, " "))


def bare_key(c: Column) -> Column:
    """Folded text without anything but word characters."""
    return F.regexp_replace(folded(c), NOT_WORD, "")


def ascii_slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by underscores; for text that is ASCII already."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def sentences(c: Column) -> Column:
    """Sentences of the collapsed text; quotes and brackets that close one before the gap are dropped with it."""
    return F.filter(F.split(collapsed(c), BOUNDARY), lambda s: s != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams joined by spaces, with repeats."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sanitized(c: Column) -> Column:
    """Only ASCII letters, digits, white space and a fixed set of signs."""
    return F.regexp_replace(text_of(c), r"[^a-zA-Z0-9\s.,\-+\\/*%$!?\[\](){}]", "")


def without_context(c: Column) -> Column:
    """Without style-analysis and context blocks."""
    return F.regexp_replace(text_of(c), r"(?s)<style_analysis>.*?</style_analysis>|<CONTEXT>.*?</CONTEXT>", "")


def without_thinking(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?s)<think>.*?</think>", "")


def any_choice(c: Column) -> Column:
    """The first A to D that stands alone after upper-casing; null if none."""
    return F.nullif(F.regexp_extract(F.upper(text_of(c)), r"\b([ABCD])\b", 1), F.lit(""))


def field_choice(c: Column) -> Column:
    """The first field between semicolons that is exactly A to D, case kept; null if none."""
    fields = F.transform(F.split(text_of(c), ";"), lambda x: F.trim(x))
    return F.try_element_at(F.filter(fields, lambda x: x.isin("A", "B", "C", "D")), F.lit(1))


def layered_choice(c: Column) -> Column:
    """``;X;``, else the bare letter, else a letter that stands alone; upper-cased; null if none."""
    up = F.upper(F.trim(text_of(c)))
    marked = F.nullif(F.regexp_extract(up, r";\s*([ABCD])\s*;", 1), F.lit(""))
    bare = F.when(up.isin("A", "B", "C", "D"), up)
    return F.coalesce(marked, bare, F.nullif(F.regexp_extract(up, r"\b([ABCD])\b", 1), F.lit("")))


def sha256(c: Column) -> Column:
    return F.sha2(text_of(c), 256)


def gram_digest(c: Column) -> Column:
    """What stands for a removed span: 16 hex digits of its digest and its number of words."""
    return F.concat(F.lit("["), F.substring(F.sha2(c, 256), 1, 16), F.lit(":"), F.size(F.split(c, " ")).cast("string"), F.lit("]"))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(text_of(c)) / 3.6).cast("int")


def dialogue_ratio(c: Column) -> Column:
    """Twice the share of short upper-case lines among lines that aren't blank, at most 1."""
    lines = F.filter(F.transform(F.split(text_of(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    loud = F.filter(lines, lambda x: (F.length(x) < 40) & (F.upper(x) == x) & (F.lower(x) != x))
    return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.size(loud) / F.size(lines)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double; 0.0 where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
