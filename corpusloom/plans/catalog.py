"""Queries over whole tables, each with its equivalent for DuckDB where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, chunking, entities, evaluation, instrument, overlap, sampling, scenes
from . import extraction, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pieces of SQL that several oracles share
NORM = r"trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
SENTENCES = (
    r"""sents AS (SELECT doc_id, s, i FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace("""
    + NORM.format("text")
    + r""", '([.!?])["'')\]]*\s+([A-Z0-9"''(\[])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)))"""
)
CHUNKS = (
    "WITH RECURSIVE "
    + SENTENCES
    + """, w AS (SELECT doc_id, s, i, len(string_split(s, ' ')) AS w FROM sents),
 step(doc_id, i, n, g, big) AS (
  SELECT doc_id, i, CASE WHEN w > 200 THEN 0 ELSE w END, 1, w > 200 FROM w WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.i, CASE WHEN w.w > 200 THEN 0 WHEN p.n = 0 OR p.big OR p.n + w.w > 200 THEN w.w ELSE p.n + w.w END,
   CASE WHEN w.w > 200 OR p.big OR p.n + w.w > 200 THEN p.g + 1 ELSE p.g END, w.w > 200
  FROM step p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1),
 grouped AS (SELECT doc_id, g, any_value(big) AS big, string_agg(s, ' ' ORDER BY i) AS t FROM step JOIN w USING (doc_id, i) GROUP BY doc_id, g),
 cut AS (SELECT doc_id, g, 0 AS k, t FROM grouped WHERE NOT big
  UNION ALL SELECT doc_id, g, k, array_to_string(list_slice(l, k * 200 + 1, k * 200 + 200), ' ') FROM (SELECT doc_id, g, l, unnest(range((len(l) + 199) // 200)) AS k FROM (SELECT doc_id, g, string_split(t, ' ') AS l FROM grouped WHERE big))),
 chunks AS (SELECT doc_id, CAST(row_number() OVER o - 1 AS INT) AS chunk_index, t AS text, CAST(sum(len(string_split(t, ' '))) OVER o AS INT) AS end_word, CAST(len(string_split(t, ' ')) AS INT) AS n
  FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY g, k))
"""
)
TOKENS = r"""regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+(?:''[a-z0-9]+)*')"""
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda x: x <> '')"


# ---------------------------------------------------------------- text and chunks
@query("WITH " + SENTENCES + " SELECT doc_id, CAST(i - 1 AS INT) AS pos, s AS sentence FROM sents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query(CHUNKS + "SELECT doc_id, chunk_index, text, end_word - n AS start_word, end_word, n AS word_count, sha256(text) AS sha256 FROM chunks")
def chunk_greedy_200(spark, sf_dir):
    return chunking.source_reference(chunking.split_text(table(spark, sf_dir, "documents"), 200))


@query(CHUNKS + "SELECT lang, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_words, max(n) AS longest FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("lang", chunking.packed(X.sentences(F.col("text")), 200).alias("c"))
    n = F.transform("c", lambda c: c.n)
    per = chunks.select("lang", F.size("c").cast("long").alias("k"), F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).alias("w"), F.array_max(n).alias("m"))
    return per.groupBy("lang").agg(F.sum("k").alias("n_chunks"), F.sum("w").alias("n_words"), F.max("m").alias("longest"))


@query(
    CHUNKS
    + """, ws AS (SELECT doc_id, flatten(list(string_split(text, ' ') ORDER BY chunk_index)) AS w FROM chunks GROUP BY doc_id)
 SELECT doc_id, chunk_index, text, array_to_string(list_slice(w, greatest(1, end_word - n - 50 + 1), end_word - n), ' ') AS before, array_to_string(list_slice(w, end_word + 1, end_word + 50), ' ') AS after FROM chunks JOIN ws USING (doc_id)"""
)
def neighbor_context(spark, sf_dir):
    return chunking.with_neighbours(table(spark, sf_dir, "documents"), 200, 50)


@query(
    CHUNKS
    + ", k AS (SELECT doc_id, count(*) AS k FROM chunks GROUP BY doc_id), a AS (SELECT doc_id, CASE WHEN coalesce(k, 0) > 1 THEN array_to_string(list_slice("
    + WORDS.format("text")
    + ", 1, 350), ' ') ELSE '' END AS abstract FROM documents LEFT JOIN k USING (doc_id)) SELECT doc_id, abstract, CASE WHEN abstract = '' THEN '' ELSE sha256(abstract) END AS abstract_sha256 FROM a"
)
def abstract_fallback(spark, sf_dir):
    return chunking.abstract_fallback(table(spark, sf_dir, "documents"))


@query("SELECT t AS token, count(*) AS n FROM (SELECT unnest(" + TOKENS.format("text") + ") AS t FROM documents) GROUP BY t ORDER BY n DESC, t LIMIT 100")
def word_freq_topk(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(X.check_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query("SELECT doc_id, CAST(len(" + TOKENS.format("text") + ") AS INT) AS n_tokens, CAST(len(list_distinct(" + TOKENS.format("text") + ")) AS INT) AS n_distinct FROM documents")
def check_token_counts(spark, sf_dir):
    t = X.check_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(r"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: replace(lower(x), 'ß', 'ss')))) AS INT) AS n_words FROM documents")
def folded_word_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.word_set(F.col("text"))).alias("n_words"))


@query("SELECT s AS sha256, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, sha256(text) AS s FROM documents) GROUP BY s HAVING count(*) > 1")
def sha_exact_dups(spark, sf_dir):
    return overlap.exact_groups(table(spark, sf_dir, "documents"))


@query(r"SELECT page_id, regexp_replace(html, '[^a-zA-Z0-9\s.,\-+\\/*%$!?\[\](){}]', '', 'g') AS prompt FROM pages")
def sanitize_prompt(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitized(F.col("html")).alias("prompt"))


@query(
    r"""SELECT conv_id, turn, nullif(regexp_extract(upper(text), '\b([ABCD])\b', 1), '') AS loose,
 list_filter(list_transform(string_split(text, ';'), lambda x: trim(x)), lambda x: x IN ('A', 'B', 'C', 'D'))[1] AS field FROM conversations"""
)
def choice_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.any_choice(F.col("text")).alias("loose"), X.field_choice(F.col("text")).alias("field"))


@query("SELECT doc_id, CAST(floor(length(text) / 3.6) AS INT) AS tokens, substr(text, 11, 40) AS slice FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"), F.substring("text", 11, 40).alias("slice"))


@query(
    "SELECT doc_id, trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS spaced, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', '', 'g') AS bare FROM documents"
)
def alias_keys(spark, sf_dir):
    head = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.ascii_slug(F.concat_ws(" ", "source", "lang")).alias("slug"), X.spaced_key(head).alias("spaced"), X.bare_key(head).alias("bare"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', 'N', 'g') AS text, '[' || substr(sha256(text), 1, 16) || ':' || len(string_split(text, ' ')) || ']' AS redaction FROM documents")
def redacted_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[0-9]+", "N").alias("text"), X.gram_digest(F.col("text")).alias("redaction"))


# ---------------------------------------------------------------- overlap
RUNS = (
    "WITH t AS (SELECT item_id, "
    + TOKENS.format("text")
    + " AS t FROM benchmark), u AS (SELECT doc_id, "
    + TOKENS.format("text")
    + """ AS t FROM documents),
 a AS (SELECT item_id, p, array_to_string(list_slice(t, p + 1, p + 6), ' ') AS g FROM (SELECT item_id, t, unnest(range(len(t) - 5)) AS p FROM t WHERE len(t) >= 6)),
 b AS (SELECT doc_id, q, array_to_string(list_slice(t, q + 1, q + 6), ' ') AS g FROM (SELECT doc_id, t, unnest(range(len(t) - 5)) AS q FROM u WHERE len(t) >= 6)),
 m AS (SELECT item_id, doc_id, p, p - q AS d, p - row_number() OVER (PARTITION BY item_id, doc_id, p - q ORDER BY p) AS k FROM a JOIN b USING (g)),
 runs AS (SELECT item_id, doc_id, min(p) AS start, count(*) + 5 AS run FROM m GROUP BY item_id, doc_id, d, k)
"""
)


def _runs(spark, sf_dir):
    return overlap.shared_runs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(RUNS + "SELECT item_id, doc_id, CAST(start AS INT) AS start, run FROM runs")
def shared_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(RUNS + "SELECT item_id, CAST(least(max(run), 25) AS INT) AS longest, count(DISTINCT start) AS n_starts, least(max(run), 25) >= 8 AS fails FROM runs GROUP BY item_id")
def longest_shared_run(spark, sf_dir):
    return overlap.longest_runs(_runs(spark, sf_dir), "item_id")


@query(RUNS + ", l AS (SELECT item_id, CAST(least(max(run), 25) AS INT) AS longest FROM runs GROUP BY item_id) SELECT longest, count(*) AS n FROM l GROUP BY longest")
def overlap_histogram(spark, sf_dir):
    return overlap.histogram(overlap.longest_runs(_runs(spark, sf_dir), "item_id"))


def _gram(n: int) -> str:
    a, b = (f"list_distinct(list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string(list_slice({x}, i, i + {n} - 1), ' ')))" for x in "ab")
    i, u = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {u} = 0 THEN 0.0 ELSE {i} / {u} END AS jaccard_{n}"


@query(
    RUNS
    + ", pairs AS (SELECT DISTINCT item_id, doc_id FROM runs), w AS (SELECT item_id, doc_id, "
    + WORDS.format("x.text")
    + " AS a, "
    + WORDS.format("d.text")
    + " AS b FROM pairs JOIN benchmark x USING (item_id) JOIN documents d USING (doc_id)) SELECT item_id, doc_id, "
    + ", ".join(map(_gram, (5, 7, 11)))
    + " FROM w"
)
def ngram_jaccard_pairs(spark, sf_dir):
    pairs = _runs(spark, sf_dir).select("item_id", "doc_id").distinct()
    a = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"))
    return overlap.gram_jaccard(pairs.join(a, "item_id").join(b, "doc_id"), "a", "b").drop("a", "b")


@query(
    RUNS
    + ", pairs AS (SELECT DISTINCT item_id, doc_id FROM runs), s AS (SELECT item_id, doc_id, list_distinct(t.t) AS a, list_distinct(u.t) AS b FROM pairs JOIN t USING (item_id) JOIN u USING (doc_id)) SELECT item_id, max(len(list_intersect(a, b)) / len(a)) AS containment, max(len(list_intersect(a, b)) / len(a)) >= 0.6 AS restates FROM s GROUP BY item_id"
)
def containment_ratio(spark, sf_dir):
    pairs = _runs(spark, sf_dir).select("item_id", "doc_id").distinct()
    a = table(spark, sf_dir, "benchmark").select("item_id", X.check_tokens(F.col("text")).alias("a"))
    b = table(spark, sf_dir, "documents").select("doc_id", X.check_tokens(F.col("text")).alias("b"))
    share = pairs.join(a, "item_id").join(b, "doc_id").select("item_id", overlap.containment(F.col("a"), F.col("b")).alias("c"))
    return share.groupBy("item_id").agg(F.max("c").alias("containment"), (F.max("c") >= 0.6).alias("restates"))


@query()
def minhash_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", overlap.token_minhash()("text").alias("sentence_minhash"))


@query(
    """WITH c AS (SELECT label, d, avg(CAST(embedding[d] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS d FROM embeddings) GROUP BY label, d),
 v AS (SELECT vec_id, label, d, CAST(embedding[d] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS d FROM embeddings))
 SELECT v.label, round(avg(s), 6) AS mean_cosine FROM (SELECT vec_id, v.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS s FROM v JOIN c ON v.label = c.label AND v.d = c.d GROUP BY vec_id, v.label) v GROUP BY v.label"""
)
def label_centroid_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")).select("label", F.col("c.m").alias("centre"))
    s = e.join(c, "label").select("label", X.cosine(F.col("embedding"), F.col("centre")).alias("s"))
    return s.groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean_cosine"))


# ---------------------------------------------------------------- ordered rows
@query("SELECT conv_id, turn, lag(role) OVER w AS preceded_by, lead(role) OVER w AS followed_by FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def chain_links(spark, sf_dir):
    return scenes.chain(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "preceded_by", "followed_by")


@query(
    "SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS previous, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS near FROM conversations"
)
def prev_units_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    both = scenes.neighbourhood(scenes.previous(c, "conv_id", "turn", "text", 3), "conv_id", "turn", "role", 2)
    return both.select("conv_id", "turn", F.array_join("previous", "|").alias("previous"), F.array_join("near", ",").alias("near"))


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 step(conv_id, turn, i, total, n, w) AS (SELECT conv_id, turn, i, s, 1, 0 FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.turn, r.i, CASE WHEN p.total + r.s > 600 OR p.n >= 3 THEN r.s ELSE p.total + r.s END, CASE WHEN p.total + r.s > 600 OR p.n >= 3 THEN 1 ELSE p.n + 1 END, CASE WHEN p.total + r.s > 600 OR p.n >= 3 THEN p.w + 1 ELSE p.w END FROM step p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1)
 SELECT conv_id, turn, CAST(w AS INT) AS "window", CAST((i - 1) // 5 AS INT) AS tile FROM step"""
)
def greedy_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    w = scenes.greedy_windows(c, "conv_id", "turn", "size", 600, 3)
    return scenes.tiles(w, "conv_id", "turn").select("conv_id", "turn", "window", "tile")


PARAGRAPHS = "p AS (SELECT doc_id, i, length(l) AS n, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(l) + 1) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"


def _paragraphs(spark, sf_dir):
    def placed(lines):
        starts = F.aggregate(lines, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
        return X.bound(starts, lambda at: F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), F.get(at, i).alias("start"), F.element_at(at, -1).alias("total"))))

    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.bound(F.split("text", "\n"), placed)).alias("i", "_p"))
    return p.select("doc_id", "i", "_p.total", "_p.n", "_p.start")


@query(
    "WITH " + PARAGRAPHS + ", o AS (SELECT *, unnest(range(CAST(greatest(0, (CAST(start AS BIGINT) - 3000) // 2000 + 1) AS BIGINT), CAST(start AS BIGINT) // 2000 + 1)) AS w FROM p WHERE start < total AND start >= 3000 UNION ALL SELECT *, unnest(range(0, CAST(start AS BIGINT) // 2000 + 1)) AS w FROM p WHERE start < 3000) SELECT doc_id, CAST(w * 2000 AS BIGINT) AS window_start, count(*) AS spans, CAST(sum(n) AS BIGINT) AS chars FROM o GROUP BY doc_id, w"
)
def page_windows(spark, sf_dir):
    w = scenes.page_windows(_paragraphs(spark, sf_dir), "doc_id", "start", "total", 3000, 2000)
    return w.groupBy("doc_id", "window_start").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").cast("long").alias("chars"))


@query(
    "WITH " + PARAGRAPHS + ", k AS (SELECT doc_id, start, start + n AS stop FROM p WHERE n >= 100), r AS (SELECT doc_id, start, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM k) SELECT doc_id, CAST(reach AS BIGINT) AS gap_start, CAST(start AS BIGINT) AS gap_end FROM r WHERE reach < start"
)
def source_gaps(spark, sf_dir):
    k = _paragraphs(spark, sf_dir).where("n >= 100").withColumn("stop", F.col("start") + F.col("n"))
    return scenes.gaps(k, "doc_id", "start", "stop")


@query(
    "WITH s AS (SELECT conv_id, list_distinct("
    + TOKENS.format("text")
    + """) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
 j AS (SELECT a.conv_id, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS s FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.i - a.i BETWEEN 1 AND 11)
 SELECT conv_id, list_sort(list(s))[len(list(s)) // 2 + 1] AS median, CAST(count(*) AS INT) AS pairs FROM j GROUP BY conv_id"""
)
def band_similarity_median(spark, sf_dir):
    return scenes.band_median(table(spark, sf_dir, "conversations"), "conv_id", "turn", X.check_tokens(F.col("text")))


# ---------------------------------------------------------------- numbers
@query(r"SELECT doc_id, n AS number, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[-/:.][0-9]+)*')) AS n FROM documents) GROUP BY doc_id, n")
def number_extract(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(scenes.numbers(F.col("text"))).alias("number"))
    return n.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("times"))


@query(
    r"""WITH n AS (SELECT source AS grp, lang, x FROM (SELECT source, lang, unnest(regexp_extract_all(text, '[0-9]+(?:[-/:.][0-9]+)*')) AS x FROM documents)),
 a AS (SELECT DISTINCT grp, x FROM n WHERE lang = 'en'), b AS (SELECT DISTINCT grp, x FROM n WHERE lang <> 'en'),
 m AS (SELECT grp, x FROM a WHERE length(x) >= 2 EXCEPT SELECT grp, x FROM b)
 SELECT m.grp AS source, m.x AS number, min(b.x) AS original FROM m JOIN b ON m.grp = b.grp AND length(m.x) = length(b.x) AND hamming(m.x, b.x) = 1 GROUP BY m.grp, m.x"""
)
def drift_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("source", "lang", F.explode(scenes.numbers(F.col("text"))).alias("number"))
    return scenes.drifted(n.where("lang = 'en'"), n.where("lang <> 'en'"), "source")


@query(
    r"SELECT doc_id, s AS stamp, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text || repeat(' rev. ' || (doc_id % 28 + 1) || '/3/1998', CAST(doc_id % 4 AS INT)), '\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b')) AS s FROM documents) GROUP BY doc_id, s HAVING count(*) >= 2"
)
def revision_stamps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stamp = F.repeat(F.format_string(" rev. %d/3/1998", F.col("doc_id") % 28 + 1), (F.col("doc_id") % 4).cast("int"))
    return scenes.stamps(d.withColumn("text", F.concat("text", stamp)), "doc_id")


# ---------------------------------------------------------------- evaluation
JUDGED = "j AS (SELECT doc_id, lang AS condition, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN toxic = 1 THEN 'B' ELSE 'A' END AS pred, source FROM labels JOIN documents USING (doc_id))"


def _judged(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    pred = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("toxic") == 1, "B").otherwise("A")
    return j.select("doc_id", F.col("lang").alias("condition"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("gold"), pred.alias("pred"), "source")


@query("WITH " + JUDGED + " SELECT condition, count(*) FILTER (pred = gold) AS correct, count(pred) AS valid, count(*) AS total, count(*) FILTER (pred = gold) / count(*) AS accuracy, count(*) FILTER (pred = gold) / nullif(count(pred), 0) AS valid_accuracy, count(*) - count(pred) AS invalid FROM j GROUP BY condition")
def mcq_summary(spark, sf_dir):
    return evaluation.summary(_judged(spark, sf_dir))


CELLS = "c AS (SELECT condition AS arm, source AS question_id, count(*) FILTER (pred = gold) AS correct, count(pred) AS total, count(*) - count(pred) AS unparseable FROM j GROUP BY ALL)"


def _cells(spark, sf_dir):
    return evaluation.cells(_judged(spark, sf_dir).select(F.col("condition").alias("arm"), F.col("source").alias("question_id"), (F.col("pred") == F.col("gold")).alias("correct"), F.col("pred").alias("choice")))


@query("WITH " + JUDGED + ", " + CELLS + " SELECT arm, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS answered, CAST(sum(unparseable) AS BIGINT) AS unparseable, count(*) AS questions, sum(correct) / nullif(sum(total), 0) AS accuracy FROM c GROUP BY arm")
def arm_summary(spark, sf_dir):
    return evaluation.arm_summary(_cells(spark, sf_dir))


@query("WITH " + JUDGED + ", " + CELLS + " SELECT arm, question_id FROM c WHERE total > 0 AND correct / total >= 0.6")
def leaky_filter(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return c.where((F.col("total") > 0) & (F.col("correct") / F.col("total") >= 0.6)).select("arm", "question_id")


@query("WITH " + JUDGED + ", " + CELLS + " SELECT a.arm AS arm_a, b.arm AS arm_b, a.question_id, a.correct AS value_a, b.correct AS value_b, a.correct - b.correct AS difference FROM c a JOIN c b USING (question_id) WHERE a.arm < b.arm")
def paired_difference(spark, sf_dir):
    c = _cells(spark, sf_dir)
    sides = [c.withColumnRenamed("arm", x) for x in ("arm_a", "arm_b")]
    a, b = (d.select(x, "question_id", F.col("correct").alias(v)) for d, x, v in zip(sides, ("arm_a", "arm_b"), ("value_a", "value_b")))
    return a.join(b, "question_id").where("arm_a < arm_b").withColumn("difference", F.col("value_a") - F.col("value_b"))


@query("WITH " + JUDGED + ", " + CELLS + ", l AS (SELECT question_id FROM c WHERE arm = 'en' AND total > 0 AND correct / total >= 0.6), m AS (SELECT 'all' AS stratum, * FROM c UNION ALL SELECT 'non_leaky', * FROM c WHERE question_id NOT IN (SELECT question_id FROM l)) SELECT arm, stratum, count(*) AS questions, CAST(sum(total) AS BIGINT) AS answered, CAST(sum(unparseable) AS BIGINT) AS unparseable, CAST(sum(correct) AS BIGINT) AS correct, sum(correct) / nullif(sum(total), 0) AS accuracy FROM m GROUP BY arm, stratum")
def stratified_arms(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return evaluation.stratified_summary(c, evaluation.leaky(c, arm="en"))


@query("WITH " + JUDGED + " SELECT condition AS arm, letter, coalesce(count(*) FILTER (pred = letter) / nullif(count(pred), 0), 0.0) AS share FROM j, (SELECT unnest(['A', 'B', 'C', 'D']) AS letter) GROUP BY condition, letter")
def position_bias(spark, sf_dir):
    return evaluation.position_bias(_judged(spark, sf_dir).select(F.col("condition").alias("arm"), F.col("pred").alias("choice")))


@query()
def question_bootstrap_ci(spark, sf_dir):
    return evaluation.question_bootstrap(_cells(spark, sf_dir))


@query()
def cluster_bootstrap_ci(spark, sf_dir):
    j = _judged(spark, sf_dir).withColumn("correct", F.coalesce((F.col("pred") == F.col("gold")).cast("int"), F.lit(0)))
    return evaluation.cluster_bootstrap(j.withColumn("group", F.lit("all")), "group", "source", condition="condition", order="doc_id", versus=("en", "de"))


EXPANDED = "x AS (SELECT turn + conv_id * 100 AS idx, (SELECT 'c' || conv_id) AS text, text AS question, CASE turn % 5 WHEN 0 THEN 'a ' WHEN 1 THEN 'B' WHEN 2 THEN ' c' WHEN 3 THEN 'E' ELSE NULL END AS answer FROM conversations)"


@query(
    "WITH "
    + EXPANDED
    + " SELECT sha256(text) || ':' || min(idx) AS document_id, min(idx) AS source_index, text, array_to_string(list(question ORDER BY idx), '|') AS questions, array_to_string(list(upper(trim(answer)) ORDER BY idx), '|') AS answers FROM x WHERE upper(trim(answer)) IN ('A', 'B', 'C', 'D') AND question <> '' GROUP BY text"
)
def grouped_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    letter = F.when(F.col("turn") % 5 == 0, "a ").when(F.col("turn") % 5 == 1, "B").when(F.col("turn") % 5 == 2, " c").when(F.col("turn") % 5 == 3, "E")
    x = c.select((F.col("turn") + F.col("conv_id") * 100).alias("idx"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("text"), F.col("text").alias("question"), letter.alias("answer"))
    return evaluation.grouped_questions(x).withColumn("questions", F.array_join("questions", "|")).withColumn("answers", F.array_join("answers", "|"))


@query("SELECT count(*) AS documents, sha256(string_agg(sha256(text) || ':' || doc_id, chr(10) ORDER BY doc_id) || chr(10)) AS selection_sha256 FROM documents")
def selection_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(evaluation.document_id(F.col("text"), F.col("doc_id")).alias("document_id"), F.col("doc_id").alias("source_index"))
    return evaluation.manifest(d)


# ---------------------------------------------------------------- entities
MENTIONS = r"m AS (SELECT source, doc_id * 1000000 + i AS pos, n AS name, lang AS type FROM (SELECT source, doc_id, lang, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM (SELECT source, doc_id, lang, regexp_extract_all(text, '[A-Z][a-z]+[.,]?') AS l FROM documents)))"


def _mentions(spark, sf_dir):
    names = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+[.,]?"), F.lit(0))
    m = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("type"), F.posexplode(names).alias("i", "name"))
    return m.select("source", (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("pos"), "name", "type")


@query(
    "WITH "
    + MENTIONS
    + r", f AS (SELECT source, name, min(pos) AS p, regexp_replace(lower(name), '[^\p{L}\p{N}_]+', '', 'g') AS key FROM m GROUP BY source, name) SELECT source, key, array_to_string(list(name ORDER BY p, name), '|') AS aliases FROM f GROUP BY source, key HAVING count(*) > 1"
)
def entity_groups(spark, sf_dir):
    return entities.alias_groups(_mentions(spark, sf_dir), "source").withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "WITH "
    + MENTIONS
    + ", c AS (SELECT source, lower(regexp_replace(name, '[.,]$', '')) AS entity_id, type, count(*) AS n, min(pos) AS p FROM m GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source, entity_id) AS mentions, row_number() OVER (PARTITION BY source, entity_id ORDER BY n DESC, p) AS k FROM c) SELECT source, entity_id, type, CAST(mentions AS BIGINT) AS mentions FROM r WHERE k = 1"
)
def majority_type(spark, sf_dir):
    m = _mentions(spark, sf_dir).withColumn("entity_id", F.lower(F.regexp_replace("name", "[.,]$", "")))
    return entities.majority_type(m, "source")


@query(
    "WITH n AS (SELECT s_nationkey, s_name AS name, list_distinct(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM supplier) SELECT a.s_nationkey, a.name AS left_name, b.name AS right_name, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM n a JOIN n b ON a.s_nationkey = b.s_nationkey AND a.name < b.name WHERE len(a.t) >= 2 AND len(b.t) >= 2 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.3"
)
def alias_pairs_token(spark, sf_dir):
    return entities.token_pairs(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", 0.3)


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS canonical_id FROM supplier")
def canonical_slug(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", entities.canonical_id("s_name").alias("canonical_id"))


@query("SELECT event_id, CASE WHEN event_type IN ('person', 'event', 'click', 'view') THEN event_type ELSE 'other' END AS type, CASE WHEN event_type NOT IN ('person', 'event', 'click', 'view') THEN event_type END AS original FROM events")
def type_vocabulary(spark, sf_dir):
    kind, original = entities.typed(F.col("event_type"), ("person", "event", "click", "view"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("type"), original.alias("original"))


# ---------------------------------------------------------------- coverage and references
@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT coalesce(d.doc_id, p.page_id) AS id, CASE WHEN p.page_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'present' END AS state FROM documents d FULL OUTER JOIN pages p ON d.doc_id = p.page_id")
def missing_full_outer(spark, sf_dir):
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    state = F.when(F.col("page_id").isNull(), "missing").when(F.col("doc_id").isNull(), "unknown").otherwise("present")
    return d.join(p, d["doc_id"] == p["page_id"], "full").select(F.coalesce("doc_id", "page_id").alias("id"), state.alias("state"))


@query("SELECT conv_id, turn, conv_id || '#' || turn AS ref, turn + 1 AS cause FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def dangling_refs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    known = c.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("_r"))
    cited = c.select("conv_id", "turn", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"), (F.col("turn") + 1).alias("cause"))
    at = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("cause").cast("string"))
    return cited.join(known, at == F.col("_r"), "left_anti")


@query("SELECT role, length(text) AS size, count(*) AS n FROM conversations GROUP BY role, length(text) HAVING count(*) > 2")
def repeated_values(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", F.length("text").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, max(count(*)) OVER () / sum(count(*)) OVER () AS modal_share FROM events GROUP BY event_type")
def value_distribution(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    return g.select("event_type", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.max("n").over(every) / F.sum("n").over(every)).alias("modal_share"))


@query("SELECT conv_id, count(*) AS turns, bool_and(turn = k) AS contiguous FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id")
def order_contiguity(spark, sf_dir):
    c = entities.ranked(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("turn") == F.col("rank") - 1).alias("contiguous"))


# ---------------------------------------------------------------- prompts and JSON
@query("SELECT doc_id, condition, 'Context: ' || CASE condition WHEN 'no_context' THEN '' WHEN 'original' THEN text ELSE sha256(text) END || chr(10) || 'Question: ' || source || '?' AS prompt FROM documents, (SELECT unnest(['no_context', 'original', 'knowledge_units']) AS condition)")
def prompt_builder(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("condition", F.explode(F.array(F.lit("no_context"), F.lit("original"), F.lit("knowledge_units"))))
    context = F.when(F.col("condition") == "no_context", "").when(F.col("condition") == "original", F.col("text")).otherwise(F.sha2("text", 256))
    return rows.select("doc_id", "condition", F.format_string("Context: %s\nQuestion: %s?", context, F.col("source")).alias("prompt"))


@query("SELECT conv_id, '[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\",\"target_id\":null}', ',' ORDER BY turn) || ']' AS context FROM conversations GROUP BY conv_id")
def ku_context_json(spark, sf_dir):
    units = F.array_sort(F.collect_list(F.struct("turn", "role", F.lit(None).cast("string").alias("target_id"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(units, {"ignoreNullFields": "false"}).alias("context"))


# ---------------------------------------------------------------- models, samples and checks
@query()
def extract_units(spark, sf_dir):
    units = extraction.extract(table(spark, sf_dir, "documents"), models.StubModel(), extraction.Config(chunk_words=500, context_words=100))
    return units.select("doc_id", "chunk_index", F.to_json("unit").alias("unit"), "sha256", F.size("sentence_minhash").alias("permutations"), "error")


@query()
def canonical_entities(spark, sf_dir):
    units = extraction.extract(table(spark, sf_dir, "documents"), models.StubModel(), extraction.Config(chunk_words=500, context_words=0))
    return extraction.canonical(units)


@query()
def judge_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("question_index"), F.lit("original").alias("condition"), F.col("role").alias("question"), F.col("text").alias("context"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("turn") % 4 + 1).cast("int")).alias("gold"))
    return evaluation.summary(extraction.judged(q, models.StubModel()))


@query()
def stratified_scenes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("scene_index"), F.size(X.words(F.col("text"))).alias("word_count"))
    return instrument.sampled_scenes(d, 25, doc="source")


@query()
def shuffled_options(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), X.words(F.col("text")).alias("options"), F.lit(0).alias("correct_index"))
    return sampling.shuffled_options(q, 3).select("question_id", "sample", F.array_join("shown", "|").alias("shown"), "correct_position")


@query("SELECT 'C1' AS check_id, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(n AS DOUBLE) AS n_violations FROM (SELECT count(*) AS n FROM (SELECT doc_id, count(*) AS k FROM labels GROUP BY doc_id) l FULL JOIN documents d USING (doc_id) WHERE k IS NULL OR k > 1 OR d.text IS NULL)")
def coverage_check(spark, sf_dir):
    units = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("scene_id"))
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("scene_id"))
    r = checks.coverage(units, expected)
    return r.select("check_id", "status", F.col("detail")["n_violations"].alias("n_violations"))


@query(RUNS + "SELECT 'C2' AS check_id, CASE WHEN count(*) FILTER (r >= 8) > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, CAST(coalesce(max(r), 0) AS DOUBLE) AS longest, CAST(count(*) FILTER (r >= 8) AS DOUBLE) AS n_violations FROM (SELECT item_id, least(max(run), 25) AS r FROM runs GROUP BY item_id)")
def verbatim_check(spark, sf_dir):
    fields = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text")
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("scene_id"), "text")
    r = checks.verbatim(fields, source, adjudicate=False)
    return r.select("check_id", "status", F.col("detail")["longest"].alias("longest"), F.col("detail")["n_violations"].alias("n_violations"))
