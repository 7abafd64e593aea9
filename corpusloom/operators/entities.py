"""Entities: identifiers, semantic classes, alias groups, candidate pairs, majority types and rewriting by aliases."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.lineage import cut

#: fixed values: the closed vocabulary of entity types
ENTITY_TYPES = ("person", "organization", "location", "concept", "method", "object", "event", "other")


@F.pandas_udf(T.StringType())
def canonical_id(names: pd.Series) -> pd.Series:
    """ASCII slug after compatibility decomposition; a name without any ASCII letter or digit gets a digest of itself."""

    def one(name):
        if name is None:
            return None
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
        slug = "_".join(re.findall("[a-z0-9]+", plain))
        return slug or "entity_" + hashlib.sha1(name.encode()).hexdigest()[:10]

    return names.map(one)


def typed(kind: Column, known: tuple[str, ...] = ENTITY_TYPES) -> tuple[Column, Column]:
    """(type, original): a missing type is a concept, an unknown one ``other`` with the original kept. Case matters."""
    given = F.coalesce(F.nullif(kind, F.lit("")), F.lit("concept"))
    return F.when(given.isin(*known), given).otherwise("other"), F.when(~given.isin(*known), given)


def alias_groups(mentions: DataFrame, doc: str = "doc_id", name: str = "name", place: str = "pos") -> DataFrame:
    """Names of a document that are equal once folded and stripped to word characters, in order of first sight, two or more."""
    first = mentions.groupBy(doc, name).agg(F.min(place).alias("_p")).withColumn("key", X.bare_key(F.col(name)))
    groups = first.groupBy(doc, "key").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("p"), F.col(name).alias("n")))).alias("_g"))
    return groups.where(F.size("_g") > 1).select(doc, "key", F.col("_g.n").alias("aliases"))


def majority_type(mentions: DataFrame, doc: str = "doc_id", entity: str = "entity_id", kind: str = "type", place: str = "pos") -> DataFrame:
    """The commonest type of each entity, the first seen of equals."""
    counted = mentions.groupBy(doc, entity, kind).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"))
    return counted.groupBy(doc, entity).agg(F.max_by(kind, F.struct("n", -F.col("p"))).alias(kind), F.sum("n").alias("mentions"))


#: rows of one key that meet in one task
BLOCK = 1 << 11


def _met(rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """Pairs (on, a, b) of ``rows`` with equal ``on`` and a's ``name`` before b's. A frequent key stands in parts: each row of the left in one, of the right in all."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select(*on, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts"))
    x = rows.join(counts, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    values = F.struct(*(c for c in rows.columns if c not in on))
    a = x.select(*on, F.pmod(F.xxhash64(name), F.col("_parts")).cast("int").alias("_part"), values.alias("a"))
    b = x.select(*on, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), values.alias("b"))
    # by number, since what is read here tells nothing of how many pairs it makes, by which partitions would be put together
    deal = lambda df: df.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "_part")
    return deal(a).join(deal(b), [*on, "_part"]).where(F.col(f"a.{name}") < F.col(f"b.{name}")).drop("_part")


def name_words(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(X.spaced_key(F.col(name)), " "), lambda w: w != ""))


def token_pairs(names: DataFrame, group: str, name: str = "name", least: float = 0.5) -> DataFrame:
    """Candidate aliases left < right within a group by shared words: two or more words each and Jaccard of ``least`` or more.

    A pair of that likeness shares so many words that the rarest words of each, all but those and one, share one: names
    meet by these only, and a pair is made at the first of those that it shares. No pair is made twice, so none is
    shuffled.
    """
    n = names.select(group, name).distinct().withColumn("_t", name_words(name)).where(F.size("_t") >= 2)
    words = n.select(group, name, F.explode("_t").alias("w"))
    common = words.groupBy(group, "w").agg(F.count(F.lit(1)).alias("f"))
    ordered = words.join(common, [group, "w"]).groupBy(group, name).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("_s")).select(group, name, F.col("_s.w").alias("t"))
    size = F.size("t")
    shared = F.ceil((size + F.greatest(F.lit(2), F.ceil(size * least - 1e-9))) * (least / (1 + least)) - 1e-9)
    keyed = ordered.select(group, name, "t", F.explode(F.slice("t", F.lit(1), F.greatest(F.lit(1), size - shared + 1).cast("int"))).alias("_w"))
    met = _met(keyed, [group, "_w"], name)
    both = F.array_intersect("a.t", "b.t")
    # the words are in one order on both sides, so the first that both hold is the first they meet by
    some = met.select(group, "_w", F.col(f"a.{name}").alias("left_name"), F.col(f"b.{name}").alias("right_name"), (F.size("a.t") + F.size("b.t")).alias("_n"), both.alias("_both"))
    jaccard = F.size("_both") / (F.col("_n") - F.size("_both"))
    return some.where((F.get("_both", F.lit(0)) == F.col("_w")) & (jaccard >= least)).select(group, "left_name", "right_name", jaccard.alias("jaccard"))


@F.pandas_udf(T.DoubleType())
def spelling_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two names; null where one is null."""
    out = pd.Series(np.nan, index=a.index)
    for i in np.flatnonzero((a.notna() & b.notna()).to_numpy()):
        out.iat[i] = SequenceMatcher(None, a.iat[i], b.iat[i]).ratio()
    return out


#: so many of the commonest letters are ranked by how common they are; others count as rarer, in the order of their code
RANKED = 256


def letter_bag(key: Column) -> Column:
    """The letters of a text as a set: each with how often it stood before among the sorted letters."""
    return X.bound(F.array_sort(F.filter(F.split(key, ""), lambda c: c != "")), lambda s: F.transform(s, lambda c, i: F.concat(c, (i - F.array_position(s, c) + 1).cast("string"))))


def _mask(items: Column, place) -> Column:
    """The items as bits of a long, each at ``place`` modulo 64; one without a place is left out."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return F.aggregate(items, none, lambda m, t: m.bitwiseOR(F.coalesce(F.call_function("shiftleft", one, place(t)), none)))


def _met_all(rows: DataFrame, group: str, name: str, blocks: int, settled) -> DataFrame:
    """Pairs (group, a, b, _settled) of all rows of a group, a's ``name`` before b's. Rows stand in ``blocks`` by order of group and name, each two blocks of a group meet in a task of their own.

    ``settled`` tells of the least and the greatest key and the two greatest lengths of both blocks whether its pairs are
    settled without Python.
    """
    # stored, since a block's limits are drawn anew each time the rows are dealt out
    dealt = cut(rows.repartitionByRange(blocks, group, name).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy(group, "_part").agg(F.min("_k").alias("low"), F.max("_k").alias("high"), F.max("_len").alias("len"))
    x, y = (held.select(group, F.col("_part").alias(part), F.struct("low", "high", "len").alias(side)) for part, side in (("_i", "x"), ("_j", "y")))
    two = x.join(y, group).where("_i <= _j").select(group, "_i", "_j", settled(F.least("x.low", "y.low"), F.greatest("x.high", "y.high"), F.col("x.len"), F.col("y.len")).alias("_settled"))
    values = F.struct(*(c for c in rows.columns if c != group))
    on = [group, "_i", "_j", "_settled"]
    side = lambda part, to: dealt.select(group, F.col("_part").alias(part), values.alias(to)).join(two, [group, part]).select(*on, to).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on[:3])
    return side("_i", "a").join(side("_j", "b"), on).where((F.col("_i") < F.col("_j")) | (F.col(f"a.{name}") < F.col(f"b.{name}"))).drop("_i", "_j")


def spelling_pairs(names: DataFrame, group: str, name: str = "name", least: float = 0.72, but: float | None = None) -> DataFrame:
    """left < right within a group whose folded names have a difflib ratio of ``least`` or more; ``least`` above 0.5. Those of ``token_pairs`` at ``but`` are left out.

    The ratio is twice the matched letters over all letters, so it needs (least / 2) of both lengths as common letters of
    the two bags, and neither name is longer than (2 - least) / least times the other. Of two bags with that many in
    common, the rarest letters of each (its length less the least overlap, plus two) share two: names meet by these
    twos only, each pair at the first. A group whose names are so alike that each meeting each is less work does that.
    Then the bags themselves are compared, as bits. Where the common start lacks one letter at most of those needed, the
    bags settle the ratio; what is left goes to Python. Two blocks of names that all start alike are settled so as a
    whole, and never come to Python. Equal keys meet as such.
    """
    n = names.where(F.col(group).isNotNull() & F.col(name).isNotNull()).select(group, name).distinct().withColumn("_k", X.spaced_key(F.col(name))).withColumn("_bag", letter_bag(F.col("_k")))
    common = n.select(F.explode("_bag").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(RANKED).collect()
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(common) for x in (r.t, len(common) - i))) if common else F.create_map().cast("map<string,int>")
    size = F.size("_bag")
    shortest = F.ceil(size * (least / (2 - least)) - 1e-9)
    overlap = F.ceil((size + shortest) * (least / 2) - 1e-9)
    rare = F.slice(F.array_sort(F.transform("_bag", lambda t: F.struct(F.coalesce(F.try_element_at(rank, t), F.lit(0)).alias("r"), t.alias("t")))), F.lit(1), F.greatest(F.lit(0), size - overlap + 2).cast("int"))
    twos = X.bound(F.array_sort(F.transform(rare, lambda x: x.t)), lambda s: F.flatten(F.transform(s, lambda t, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda u: F.xxhash64(t, u)))))
    # a ranked letter is a bit of its own, so bits count what two bags share of these; the others are compared as text
    longs = max(1, -(-len(common) // 64))
    bits = X.bound(F.transform("_bag", lambda t: F.try_element_at(rank, t) - 1), lambda r: F.array(*(_mask(r, lambda p, w=w: F.when(F.shiftright(p, 6) == w, p)) for w in range(longs))))
    others = F.filter("_bag", lambda t: F.try_element_at(rank, t).isNull())
    n = n.select(group, name, "_k", size.alias("_len"), F.array_distinct(twos).alias("_twos"), name_words(name).alias("_words"), bits.alias("_bits"), others.alias("_others"))
    # cut here, since the sorted letters are used many times over
    n = cut(n.withColumn("_some", _mask(F.col("_words"), lambda w: F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))
    told = n.select(group, name, "_k", F.xxhash64("_k").alias("_hash"), "_len", F.size("_words").alias("_n"), "_some", F.size("_others").alias("_odd"), *(F.get("_bits", F.lit(w)).alias(f"_bits{w}") for w in range(longs)), F.struct("_others", "_words").alias("_more"), "_twos")
    square = F.col("c") * F.col("c")
    each = n.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("c")).select(group, square.alias("_each"))
    work = n.select(group, F.explode("_twos").alias("_two")).groupBy(group, "_two").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(group).agg(F.sum(square).alias("_work"))
    dense = each.join(work, group).where("_work > _each").select(group)
    by_twos = _met(told.join(dense, group, "left_anti").withColumn("_two", F.explode("_twos")), [group, "_two"], name)

    letters = F.col("a._len") + F.col("b._len")
    lengths = F.greatest("a._len", "b._len") * least <= F.least("a._len", "b._len") * (2 - least) + 1e-9
    # difflib takes the longest common run first, the earliest of equals. Of a common start of p letters it matches p, and
    # one more if any letter is common to what follows: either the run is the start, or it is longer. So with p one short
    # of what is needed or more, the bags have what is needed if and only if the match has. From 200 letters on it leaves
    # out frequent ones
    started = lambda length: (F.ceil(length * (least / 2) + 1e-9) - 1).cast("int")
    begins = lambda p, q, n: (F.length(p) >= n) & F.startswith(q, F.substring(p, F.lit(1), n))
    sure = (F.greatest("a._len", "b._len") < 200) & begins(F.col("a._k"), F.col("b._k"), started(letters))
    shared = F.lit(0)
    for w in range(longs):
        shared = shared + F.bit_count(F.col(f"a._bits{w}").bitwiseAND(F.col(f"b._bits{w}")))
    rest = F.when((F.col("a._odd") > 0) & (F.col("b._odd") > 0), F.size(F.array_intersect("a._more._others", "b._more._others"))).otherwise(0)
    bags = (shared + rest) * 2.0 / F.greatest(letters, F.lit(1)) >= least
    words = F.col("a._n") + F.col("b._n")
    # words that share a bit may differ, so bits tell how many are common at most
    most = F.col("a._n") - F.bit_count(F.col("a._some").bitwiseAND(F.bitwise_not("b._some")))
    both = F.size(F.array_intersect("a._more._words", "b._more._words"))
    by_words = F.lit(False) if but is None else (F.col("a._n") >= 2) & (F.col("b._n") >= 2) & (most / (words - most) >= but) & (both / (words - both) >= but)
    named = [F.col(f"a.{name}").alias("left_name"), F.col(f"b.{name}").alias("right_name")]

    def settled(low: Column, high: Column, x: Column, y: Column) -> Column:
        return (F.greatest(x, y) < 200) & begins(low, high, started(x + y))

    def asked(met: DataFrame) -> DataFrame:
        """Those pairs of which Python tells that they are alike; of the sure ones it is not asked."""
        spelt = met.select(group, *named, *(F.when(~F.col("_sure"), F.col(c)).alias(to) for c, to in (("a._k", "_ka"), ("b._k", "_kb"))))
        return spelt.withColumn("_ratio", spelling_ratio("_ka", "_kb")).where(F.coalesce(F.col("_ratio"), F.lit(1.0)) >= least).select(group, "left_name", "right_name")

    other = (F.col("a._hash") != F.col("b._hash")) | (F.col("a._k") != F.col("b._k"))
    some = by_twos.where(lengths & bags & other & (F.get(F.array_intersect("a._twos", "b._twos"), F.lit(0)) == F.col("_two")) & ~by_words).withColumn("_sure", sure)
    by_group = _met_all(told.join(dense, group, "left_semi").drop("_twos"), group, name, max(1, -(-n.count() // BLOCK)), settled)
    # joined twice, since no pair that is sure should pass by Python; blocks that are settled only once
    near = by_group.where(bags & (F.col("_settled") | sure) & other & ~by_words).select(group, *named)
    unsure = by_group.where(~F.col("_settled")).where(bags & ~sure & other & ~by_words).withColumn("_sure", F.lit(False))
    same = _met(n.select(group, name, "_k", "_words", "_some", F.size("_words").alias("_n"), F.struct("_words").alias("_more")), [group, "_k"], name).where(~by_words).select(group, *named)
    return asked(some).unionByName(near).unionByName(asked(unsure)).unionByName(same)


def alias_pairs(names: DataFrame, group: str, name: str = "name", least_ratio: float = 0.72) -> DataFrame:
    """All candidate pairs of a document's names: by words, or by spelling ratio. Names of one document only are compared."""
    return token_pairs(names, group, name).select(group, "left_name", "right_name").unionByName(spelling_pairs(names, group, name, least_ratio, but=0.5))


def rewritten(mentions: DataFrame, lookup: DataFrame, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """Mentions with canonical name and id where ``lookup`` (doc, alias, canonical_name, canonical_id, ord) has their folded name; of several the last."""
    last = lookup.withColumn("_f", X.folded(F.col("alias"))).groupBy(doc, "_f").agg(F.max_by(F.struct("canonical_name", "canonical_id"), "ord").alias("_c"))
    joined = mentions.withColumn("_f", X.folded(F.col(name))).join(last, [doc, "_f"], "left")
    return joined.withColumn("canonical_name", F.coalesce("_c.canonical_name", name)).withColumn("canonical_id", F.col("_c.canonical_id")).drop("_f", "_c")


def resolved(aliases: DataFrame, most: int = 20, source: str = "alias", target: str = "canonical") -> DataFrame:
    """Chains a -> b -> c followed to their ends by pointer jumping; a cycle ends at its least name."""
    now = aliases.groupBy(source).agg(F.max(target).alias(target)).where(F.col(source) != F.col(target))
    for _ in range(most):
        after = now.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
        new = cut(now.join(after, F.col(target) == F.col("_s"), "left").select(source, F.when(F.col("_t") == F.col(source), F.least(source, target)).otherwise(F.coalesce("_t", target)).alias(target)))
        if not new.exceptAll(now).limit(1).count():
            return new
        now = new
    raise RuntimeError(f"chains did not end in {most} rounds")


def ranked(df: DataFrame, by: str, order: list[str], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
