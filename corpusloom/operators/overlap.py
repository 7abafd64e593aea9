"""Overlap between texts: shared runs of tokens, n-gram and set similarities, containment, token MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LEAST, MOST, FAIL = 6, 25, 8


def token_hashes(text: Column) -> Column:
    """A 64-bit hash for each check token."""
    return F.transform(X.check_tokens(text), lambda t: F.xxhash64(t))


def windows(h: Column, n: int) -> Column:
    """A hash for each run of n hashed tokens; null where there are fewer."""
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n)))))


def token_grams(df: DataFrame, key: str, n: int = LEAST, text: str = "text") -> DataFrame:
    """(key, pos, gram): hashed n-grams of check tokens with their places. Each text is cut into tokens once."""
    return df.select(key, F.posexplode(X.bound(token_hashes(F.col(text)), lambda h: windows(h, n))).alias("pos", "gram"))


def shared_runs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int = LEAST) -> DataFrame:
    """(left_key, right_key, start, run): maximal runs of n or more tokens that both texts share.

    One join on n-grams; places on one diagonal whose numbers rise together form an island of one run. Grams that the
    left side lacks never leave the right side's scan once the left is small enough to broadcast, which AQE decides.
    """
    a = token_grams(left, left_key, n).select(F.col(left_key), F.col("pos").alias("p"), "gram")
    b = token_grams(right, right_key, n).select(F.col(right_key), F.col("pos").alias("q"), "gram")
    met = a.join(b, "gram").select(left_key, right_key, "p", (F.col("p") - F.col("q")).alias("diagonal"))
    order = Window.partitionBy(left_key, right_key, "diagonal").orderBy("p")
    island = met.withColumn("island", F.col("p") - F.row_number().over(order))
    return island.groupBy(left_key, right_key, "diagonal", "island").agg(F.min("p").alias("start"), (F.count(F.lit(1)) + n - 1).alias("run")).select(left_key, right_key, "start", "run")


SALTS = 16


def _met(rows: DataFrame, grams: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``rows`` whose gram is among the distinct ``grams``; each gram stands in SALTS parts, so that rows of a hot one are spread."""
    parts = grams.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(parts, [*on, "_salt"], "left_semi").drop("_salt")


#: characters of one place, fields and sources together, up to which its runs are looked for within a row
ROW = 1 << 22
#: hashes looked at together by a task
SLICE = 1 << 19


def longest_matches(fields: DataFrame, sources: DataFrame, n: int = LEAST, most: int = MOST, keep: tuple[str, ...] = (), row: int = ROW) -> DataFrame:
    """(field, *keep, run, start, scope, gram): for each field the longest run of n to ``most`` tokens that a source of its scopes has.

    fields: field (unique), within (array of scope and place), text, and what ``keep`` names; sources: scope, place, text;
    rows of one place are looked at together, but no run crosses two. Of equally long runs the first is taken, and of
    several scopes there the lowest. Equal texts of one place are looked at as one.

    A place's fields and sources meet as one row, so only texts are shuffled, each once a scope; a place of more than
    ``row`` characters, of which there can be but so many, has its runs joined by grams instead.
    """
    on = ["scope", "place"]
    asked = fields.select("field", *keep, "text", F.explode("within").alias("w")).select("w.*", "field", *keep, "text")
    held = sources.select(*on, "text")
    chars = asked.select(*on, F.length("text").alias("c")).unionByName(held.select(*on, F.length("text").alias("c")))
    wide = F.broadcast(chars.groupBy(*on).agg(F.sum("c").alias("c")).where(F.col("c") > row).select(*on))
    part = lambda df, how: df.join(wide, on, how)
    grams = lambda texts: F.transform(texts, lambda t: F.coalesce(X.bound(token_hashes(t), lambda h: windows(h, n)), F.array().cast("array<bigint>")))
    # hashed below the join, since a UDF can't take lambdas
    left = part(asked, "left_anti").groupBy(*on).agg(F.collect_list(F.struct("field", *keep, "text")).alias("_f")).withColumn("_a", grams(F.col("_f.text")))
    right = part(held, "left_anti").groupBy(*on).agg(F.collect_set("text").alias("_t")).select(*on, grams(F.col("_t")).alias("_b"))
    near = left.join(right, on).select("scope", "_f", in_row(n, most)("_a", "_b").alias("_r"))
    near = near.select("scope", F.explode(F.filter(F.arrays_zip("_f", "_r"), lambda x: x["_r"] > 0)).alias("x")).select("scope", "x._f.*", F.shiftright("x._r", 32).cast("int").alias("n"), (F.col("x._r") % (1 << 32)).cast("int").alias("p"))
    far = by_grams(part(asked, "left_semi"), part(held, "left_semi"), n, most, keep)
    found = near.unionByName(far).select("field", *keep, "scope", "n", "p", F.slice(X.check_tokens(F.col("text")), F.col("p") + 1, F.col("n")).alias("gram"))
    best = found.groupBy("field").agg(F.max_by(F.struct(*keep, F.col("n").alias("run"), F.col("p").alias("start"), "scope", "gram"), F.struct("n", -F.col("p"), -F.col("scope"))).alias("b"))
    return best.select("field", "b.*")


def in_row(n: int, most: int):
    """An Arrow UDF: for each field's hashed windows of n tokens the longest run of n to ``most`` that one of the row's sources has.

    A run is its length times 2^32 plus its start; 0 where there is none. A run of k tokens stands only where one of
    k - 1 does, on both sides, so each length looks at what the one before left.
    """

    @F.arrow_udf("array<bigint>")
    def runs(fields: pa.Array, sources: pa.Array) -> pa.Array:
        def flat(column):
            # values, the text of each, and the row of each text
            texts = column.flatten()
            sizes = np.diff(texts.offsets.to_numpy())
            return texts.flatten().to_numpy(zero_copy_only=False), sizes, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))

        (a, a_sizes, a_rows), (b, b_sizes, b_rows) = flat(fields), flat(sources)
        out = np.zeros(len(a_sizes), np.int64)
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        # so many rows at a time that their hashes fit a bound; one large row stands alone
        load = np.bincount(a_rows, a_sizes, len(fields)) + np.bincount(b_rows, b_sizes, len(fields))
        group = np.cumsum(load) // SLICE
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=np.inf))
        a_at, b_at = np.searchsorted(a_rows, cuts), np.searchsorted(b_rows, cuts)
        for i in range(len(cuts) - 1):
            fs, ss = slice(a_at[i], a_at[i + 1]), slice(b_at[i], b_at[i + 1])
            lo, hi = (a_ends[fs.start] - a_sizes[fs.start], a_ends[fs.stop - 1]) if fs.stop > fs.start else (0, 0)
            left, right = (b_ends[ss.start] - b_sizes[ss.start], b_ends[ss.stop - 1]) if ss.stop > ss.start else (0, 0)
            out[fs] = _longest(a[lo:hi], a_sizes[fs], a_rows[fs], b[left:right], b_sizes[ss], b_rows[ss], n, most)
        return pa.ListArray.from_arrays(pa.array(fields.offsets.to_numpy() - fields.offsets[0].as_py(), pa.int32()), pa.array(out))

    return runs.asNondeterministic()  # else Spark moves it into the lambda that reads it


def _longest(a, a_sizes, a_rows, b, b_sizes, b_rows, n, most):
    def side(values, sizes, rows):
        text = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)[text]
        values = values.view(np.uint64)
        # the row stands in the hash, so that no text meets another row's
        return values, text, ends, np.arange(len(values)), _mixed(values, rows.astype(np.uint64)[text])

    a, a_text, a_ends, p, x = side(a, a_sizes, a_rows)
    b, _, b_ends, q, y = side(b, b_sizes, b_rows)
    run = np.zeros(len(a), np.int64)
    for k in range(n, most + 1):
        if k > n:
            p, q = p[p + (k - n) < a_ends[p]], q[q + (k - n) < b_ends[q]]
            x[p], y[q] = _mixed(x[p], a[p + (k - n)]), _mixed(y[q], b[q + (k - n)])
        held = np.unique(y[q])
        p = p[_among(x[p], held)]
        if not len(p):
            break
        run[p] = k
        q = q[_among(y[q], np.unique(x[p]))]
    got = np.flatnonzero(run)
    best = np.zeros(len(a_sizes), np.int64)
    if len(got):
        # the longest, and of those the first
        start = got - (np.cumsum(a_sizes) - a_sizes)[a_text[got]]
        first = np.flatnonzero(np.diff(a_text[got], prepend=-1))
        worth = np.maximum.reduceat((run[got] << 32) + ((1 << 31) - start), first)
        best[a_text[got][first]] = ((worth >> 32) << 32) + ((1 << 31) - (worth & 0xFFFFFFFF))
    return best


def _mixed(h, more):
    with np.errstate(over="ignore"):
        h = (h ^ (more + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _among(values, ordered):
    """Whether each value is among the ordered distinct ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def by_grams(asked: DataFrame, held: DataFrame, n: int, most: int, keep: tuple[str, ...]) -> DataFrame:
    """(field, *keep, text, scope, n, p): every run of n to ``most`` tokens of asked (scope, place, field, *keep, text) that held (scope, place, text) has.

    Whether a run of some length starts at a place is asked of distinct runs only, so a gram that stands k times in a
    field and m times in a source never makes k times m rows; only where the n tokens match are longer runs looked at.
    """
    on = ["scope", "place", "gram"]
    grams = X.bound(token_hashes(F.col("text")), lambda h: windows(h, n))
    left = asked.select("scope", "place", "field", grams.alias("_w"))
    right = held.select("scope", "place", F.xxhash64("text").alias("_row"), grams.alias("_w"))
    sought = asked.select("scope", "place", "field", F.posexplode(grams).alias("p", "gram"))
    there = held.select("scope", "place", F.xxhash64("text").alias("_row"), F.posexplode(grams).alias("q", "gram"))
    shared = sought.select(*on).distinct().join(there.select(*on).distinct(), on)
    starts = _met(sought, shared, on, ["field", "p"]).select("field", "scope", "place", "p")

    def longer(at: Column) -> Column:
        # k tokens are told by the windows of n that cover them: no slices, which would copy the whole array each
        cover = lambda k: sorted({*range(0, k - n + 1, n), k - n})
        runs = (F.when(at + (k - n) < F.size("_w"), F.struct(at.alias("at"), F.lit(k).alias("n"), F.xxhash64(*(F.get("_w", at + j) for j in cover(k))).alias("gram"))) for k in range(n + 1, most + 1))
        return F.array_compact(F.array(*runs))

    def places(starts: DataFrame, keys: list[str], texts: DataFrame, at: str) -> DataFrame:
        listed = starts.groupBy(*keys, "scope", "place").agg(F.collect_set(at).alias("_at"))
        # all runs of a text are made within its row, so that none carries the text's hashes along
        return texts.join(listed, [*keys, "scope", "place"]).select(*keys, "scope", "place", F.explode(F.flatten(F.transform("_at", longer))).alias("x")).select(*keys, "scope", "place", F.col("x.at").alias(at), "x.n", "x.gram")

    wider = places(starts, ["field"], left, "p")
    which = ["scope", "place", "n", "gram"]
    again = places(_met(there, shared, on, ["_row", "q"]).select("_row", "scope", "place", "q"), ["_row"], right, "q").select(*which).distinct()
    both = wider.select(*which).distinct().join(again, which)
    found = starts.withColumn("n", F.lit(n)).unionByName(_met(wider, both, which, ["field", "p"]).select("field", "scope", "place", "p", "n"))
    top = found.groupBy("field", "scope", "place").agg(F.max(F.struct("n", (-F.col("p")).alias("p"))).alias("b")).select("field", "scope", "place", "b.n", (-F.col("b.p")).alias("p"))
    return asked.join(top, ["field", "scope", "place"]).select("field", *keep, "text", "scope", "n", "p")


def longest_runs(runs: DataFrame, left_key: str, most: int = MOST) -> DataFrame:
    """Per left text the longest run, cut at ``most``, and whether it fails."""
    return runs.groupBy(left_key).agg(F.least(F.max("run"), F.lit(most)).cast("int").alias("longest"), F.countDistinct("start").alias("n_starts")).withColumn("fails", F.col("longest") >= FAIL)


def histogram(longest: DataFrame) -> DataFrame:
    return longest.groupBy("longest").agg(F.count(F.lit(1)).alias("n"))


def gram_jaccard(pairs: DataFrame, a: str, b: str, sizes: tuple[int, ...] = (5, 7, 11)) -> DataFrame:
    """Adds jaccard_<n> of word n-grams (white space, case kept) for each size."""
    out = pairs.withColumn("_a", X.words(F.col(a))).withColumn("_b", X.words(F.col(b)))
    for n in sizes:
        out = out.withColumn(f"jaccard_{n}", X.jaccard(F.array_distinct(X.ngrams(F.col("_a"), n)), F.array_distinct(X.ngrams(F.col("_b"), n))))
    return out.drop("_a", "_b")


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0.0 for an empty a."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


#: tokens whose digests a task keeps, and texts it makes Python strings of at a time
KEPT, TEXTS = 1 << 17, 128


def token_minhash(permutations: int = 16):
    """An Arrow UDF: text to ``permutations`` unsigned 64-bit minima of keyed BLAKE2b digests of folded word runs, as decimals.

    Minima stand in one array of a batch's texts; only TEXTS of these are strings at a time, and the digests of at most
    KEPT tokens and one text's are kept, so a task's memory doesn't grow with its input.
    """

    @F.arrow_udf("array<decimal(20,0)>")
    def signature(texts: pa.Array) -> pa.Array:
        import re

        seeds = [i.to_bytes(4, "little") for i in range(permutations)]
        word = re.compile(r"\w+")
        # digests of the tokens met, a row each; when they are KEPT or more it starts anew
        places: dict[str, int] = {}
        digests = np.empty((KEPT, permutations), np.uint64)
        minima = np.empty((len(texts), permutations), np.uint64)
        told = np.zeros(len(texts), bool)

        def place(token):
            nonlocal digests
            at = places.get(token)
            if at is None:
                at = places[token] = len(places)
                if at == len(digests):
                    digests = np.concatenate([digests, np.empty_like(digests)])
                data = token.encode()
                digests[at] = np.frombuffer(b"".join([hashlib.blake2b(s + data, digest_size=8).digest() for s in seeds]), "<u8")
            return at

        for begin in range(0, len(texts), TEXTS):
            for i, text in enumerate(texts.slice(begin, TEXTS).to_pylist(), begin):
                tokens = set(word.findall((text or "").casefold()))
                if tokens:
                    if len(places) >= KEPT:
                        places.clear()
                        digests = digests[:KEPT]
                    at = [place(t) for t in tokens]
                    minima[i] = digests[at].min(axis=0)
                    told[i] = True
        ends = np.cumsum(told) * permutations
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(minima[told].reshape(-1)).cast(pa.decimal128(20, 0)))

    return signature


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal texts of two or more rows: digest, least key, rows. Digests, not texts, are shuffled."""
    g = df.select(key, X.sha256(F.col(text)).alias("sha256")).groupBy("sha256").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")
