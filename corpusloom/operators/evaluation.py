"""Multiple-choice evaluation: valid pairs, roll-ups, leaky questions, paired differences and bootstrap intervals."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 250219413
LETTERS = ("A", "B", "C", "D")


def valid_answer(question: Column, answer: Column) -> Column:
    return (F.coalesce(question, F.lit("")) != "") & F.upper(F.trim(F.coalesce(answer, F.lit("")))).isin(*LETTERS)


def valid_pairs(rows: DataFrame, questions: str = "question", answers: str = "answer") -> DataFrame:
    """List columns cut to the shorter one and to valid pairs; rows without text or pair are left out."""
    least = F.least(F.size(questions), F.size(answers))
    pairs = F.filter(F.transform(F.slice(F.col(questions), 1, least), lambda q, i: F.struct(q.alias("q"), F.upper(F.trim(F.get(F.col(answers), i))).alias("a"))), lambda p: valid_answer(p.q, p.a))
    out = rows.withColumn("_p", F.when(least > 0, pairs).otherwise(F.array().cast("array<struct<q:string,a:string>>")))
    return out.where((F.coalesce("text", F.lit("")) != "") & (F.size("_p") > 0)).withColumn("questions", F.col("_p.q")).withColumn("answers", F.col("_p.a")).drop("_p", questions, answers)


def document_id(text: Column, index: Column) -> Column:
    return F.concat_ws(":", F.sha2(text, 256), index.cast("string"))


def grouped_questions(rows: DataFrame, index: str = "idx") -> DataFrame:
    """One row per text of an expanded table: the first row's index names it, questions keep their order."""
    good = rows.where((F.coalesce("text", F.lit("")) != "") & valid_answer(F.col("question"), F.col("answer")))
    g = good.groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.min(index).alias("source_index"), F.min("text").alias("text"), F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col("question").alias("q"), F.upper(F.trim("answer")).alias("a")))).alias("_q")
    )
    return g.select(F.concat_ws(":", "sha256", F.col("source_index").cast("string")).alias("document_id"), "source_index", "text", F.col("_q.q").alias("questions"), F.col("_q.a").alias("answers"))


def summary(judged: DataFrame, by: str = "condition", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """correct, valid, total, accuracy (an invalid answer is wrong), valid_accuracy and invalid per condition."""
    right = F.count_if(F.col(pred) == F.col(gold))
    return judged.groupBy(by).agg(right.alias("correct"), F.count(pred).alias("valid"), F.count(F.lit(1)).alias("total")).select(
        by, "correct", "valid", "total", F.try_divide("correct", "total").alias("accuracy"), F.try_divide("correct", "valid").alias("valid_accuracy"), (F.col("total") - F.col("valid")).alias("invalid")
    )


def cells(samples: DataFrame) -> DataFrame:
    """Per arm and question: correct, answered, unparseable samples."""
    return samples.groupBy("arm", "question_id").agg(F.count_if("correct").alias("correct"), F.count("choice").alias("total"), F.count_if(F.col("choice").isNull()).alias("unparseable"))


def arm_summary(cell: DataFrame) -> DataFrame:
    """Per arm: accuracy over answered samples only, and how many questions and samples stand behind it."""
    g = cell.groupBy("arm").agg(F.sum("correct").alias("correct"), F.sum("total").alias("answered"), F.sum("unparseable").alias("unparseable"), F.count(F.lit(1)).alias("questions"))
    return g.withColumn("accuracy", F.try_divide("correct", "answered"))


def leaky(cell: DataFrame, least: float = 0.6, arm: str = "none") -> DataFrame:
    """Questions that are answered without any context."""
    return cell.where((F.col("arm") == arm) & (F.col("total") > 0) & (F.col("correct") / F.col("total") >= least)).select("question_id")


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "correct") -> DataFrame:
    """Rows of both runs side by side with their difference."""
    return a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), keys).withColumn("difference", F.col("value_a") - F.col("value_b"))


def interval(values: list[float], closed: bool) -> tuple[float, float]:
    """95 % by sorted places: int(.025 n), and int(.975 n) or, ``closed``, the place before it."""
    v = sorted(values)
    return v[int(0.025 * len(v))], v[int(0.975 * len(v)) - closed]


def question_bootstrap(cell: DataFrame, by: str = "arm", order: str = "question_id", resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(by, low, high): interval of the mean accuracy over resampled questions with any answer, in the order of ``order``; zeros without any."""
    shares = cell.where("total > 0").select(by, order, (F.col("correct") / F.col("total")).alias("_x"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x, rng = pdf.sort_values(order)["_x"].tolist(), random.Random(seed)
        n = len(x)
        low, high = interval([sum(x[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples)], False)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "low": [low], "high": [high]})

    drawn = shares.groupBy(by).applyInPandas(draw, f"{by} {cell.schema[by].dataType.simpleString()}, low double, high double")
    return cell.select(by).distinct().join(drawn, by, "left").select(by, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))


def stratified_summary(cell: DataFrame, leaky_questions: DataFrame) -> DataFrame:
    """(arm, stratum, questions, answered, unparseable, correct, accuracy): of all questions, and of those that don't leak."""
    marked = cell.join(leaky_questions.select("question_id", F.lit(True).alias("_leaky")).distinct(), "question_id", "left")
    kinds = F.when(F.col("_leaky"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("non_leaky")))
    g = marked.withColumn("stratum", F.explode(kinds)).groupBy("arm", "stratum")
    sums = g.agg(F.count(F.lit(1)).alias("questions"), F.sum("total").alias("answered"), F.sum("unparseable").alias("unparseable"), F.sum("correct").alias("correct"))
    return sums.withColumn("accuracy", F.try_divide("correct", "answered"))


def position_bias(samples: DataFrame, by: str = "arm", choice: str = "choice") -> DataFrame:
    """(by, letter, share): how often each of the four letters was chosen, of all parsed choices; zeros where none was."""
    one = lambda x: F.struct(F.lit(x).alias("letter"), F.coalesce(F.try_divide(F.count_if(F.col(choice) == x), F.count(choice)), F.lit(0.0)).alias("share"))
    return samples.groupBy(by).agg(F.array(*map(one, LETTERS)).alias("_p")).select(by, F.explode("_p").alias("_p")).select(by, "_p.letter", "_p.share")


def cluster_bootstrap(judged: DataFrame, by: str, cluster: str, correct: str = "correct", condition: str | None = None, order: str | None = None, versus: tuple[str, str] | None = None, resamples: int = 10_000, seed: int = SEED) -> DataFrame:
    """(by, condition, accuracy, low, high, clusters): interval of accuracy over resampled clusters, 95 % by sorted places int(.025 n) and int(.975 n) - 1.

    All conditions of a group share each draw, and ``versus`` adds the difference of two of them, as ``a-b``. Clusters
    stand by their least ``order`` (their name without one) and are summed before any draw, so a group holds a few numbers
    for each.
    """
    rows = judged.withColumn("_c", F.lit("all") if condition is None else F.col(condition)).withColumn("_o", F.col(cluster) if order is None else F.col(order))
    sums = rows.groupBy(by, cluster, "_c").agg(F.sum(F.col(correct).cast("long")).alias("c"), F.count(F.lit(1)).alias("n"), F.min("_o").alias("_o"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf.groupby(cluster)["_o"].min().sort_values(kind="stable").index.tolist()
        size, rng = len(places), random.Random(seed)
        kinds = sorted(pdf["_c"].unique())
        wide = {k: pdf[pdf["_c"] == k].set_index(cluster)[["c", "n"]].reindex(places).fillna(0) for k in kinds}
        hits, all_ = ({k: w[x].to_numpy() for k, w in wide.items()} for x in "cn")
        got: dict[str, list[float]] = {k: [] for k in kinds}
        for _ in range(resamples):
            pick = [rng.choice(range(size)) for _ in range(size)]
            for k in kinds:
                n = all_[k][pick].sum()
                got[k].append(hits[k][pick].sum() / n if n else 0.0)
        points = {k: hits[k].sum() / all_[k].sum() for k in kinds}
        if versus and set(versus) <= set(kinds):
            a, b = versus
            name = f"{a}-{b}"
            got[name], points[name] = [x - y for x, y in zip(got[a], got[b])], points[a] - points[b]
        ends = {k: interval(v, True) for k, v in got.items()}
        return pd.DataFrame([(pdf[by].iloc[0], k, points[k], *ends[k], size) for k in got], columns=[by, "condition", "accuracy", "low", "high", "clusters"])

    kind = f"{by} {judged.schema[by].dataType.simpleString()}, condition string, accuracy double, low double, high double, clusters long"
    return sums.groupBy(by).applyInPandas(draw, kind)


def manifest(documents: DataFrame, doc: str = "document_id", order: str = "source_index") -> DataFrame:
    """Number of documents and an order-sensitive digest of their ids, one line each.

    The digest runs through the ids in order, so one task reads them: as a sorted stream, of which it holds a batch.
    """

    def run(source):
        digest, n = hashlib.sha256(), 0
        for batch in source:
            for d in batch.column(0).to_pylist():
                digest.update(f"{d or ''}\n".encode())
            n += batch.num_rows
        if not n:
            digest.update(b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["documents", "selection_sha256"])

    ids = documents.select(F.col(doc).cast("string").alias("d"), order).repartition(1).sortWithinPartitions(order, "d").select("d")
    return ids.mapInArrow(run, "documents long, selection_sha256 string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a dataset, each read whole by one task."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
