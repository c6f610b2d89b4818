"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades: 0 clean, 1 toxic, 2 severely toxic: labelled toxic, with more telling words than the median of
the toxic documents. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w.x - t_k) with t_0 <= t_1 <= ... The severity of a text is the expected grade; it is toxic where
P(grade > 0) reaches CUT.

Features are sparse: 1 + log(count) of the FEATURES words and word beginnings (PREFIXES characters, so that inflected and
compound forms count together) whose presence tells toxic from clean documents most clearly: by rank of the standardised
difference, so that a small table chooses as a large one does; only what chance explains easily (less than LEAST_Z standard
errors) is left out. The model is fitted on about SAMPLE
labelled documents at most (chosen by a hash of doc_id; copies count once); prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, sliced, table, undotted, without_names

SAMPLE, FEATURES, LEAST_Z, CUT, GRADES = 12_000, 128, 3.0, 0.5, 3
PREFIXES, KEPT_WORDS, LONG_WORD = (3, 4, 5, 6, 7, 8), 60_000, 64
WORD = re.compile(r"[^\W\d_]+")


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, grade (0 or 1 yet) of a bounded sample of labelled documents. Labels with a null in doc_id or toxic are
    left out; of several labels of one document the more severe counts."""
    grade = F.when(F.col("toxic") == 0, 0).otherwise(1)
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(grade).alias("grade"))
    n = marks.count()
    sampled = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, most / max(n, 1)) * (1 << 20))
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sampled), "doc_id").withColumn("mark", F.xxhash64("text")).dropDuplicates(["mark", "grade"])  # about `most` rows


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _features(text: str) -> Counter:
    found: Counter = Counter()
    for w, c in Counter(WORD.findall(text.lower())).items():
        for f in features_of(w):
            found[f] += c
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 200):
        rows = [_features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([list(r) for r in rows], pa.list_(pa.string())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], names=["doc_id", "grade", "words", "counts"])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, ridge: float = 0.05, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and non-decreasing thresholds: gradient ascent (Adam) on the penalised likelihood of the grades."""
    n, d = x.shape
    share = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(grades - 1)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    free = np.concatenate([np.zeros(d), start[:1], np.log(np.expm1(np.maximum(np.diff(start), 1e-3)))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        gaps = np.log1p(np.exp(free[d + 1 :]))
        cuts = free[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ free[:d]
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        row = np.arange(n)
        hi, lo = edge[row, grade], edge[row, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
        by_cut = np.zeros((n, grades + 1))
        by_cut[row, grade] += -slope_hi / p
        by_cut[row, grade + 1] += slope_lo / p
        by_cut = by_cut[:, 1:-1].sum(axis=0)
        g = np.concatenate([x.T @ ((slope_hi - slope_lo) / p) - ridge * free[:d], [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] / (1 + np.exp(-free[d + 1 :]))]) / n
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        free = free + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return free[:d], free[d] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(free[d + 1 :])))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> dict:
    """{'weights': word -> weight, 'cuts': thresholds}. Without a labelled toxic and a clean document nothing is toxic."""
    rows = labelled(docs, labels, sample)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("grade", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    counted = rows.select("doc_id", F.col("grade").cast("int").alias("grade"), "text").mapInArrow(_counts, schema).persist()
    try:
        n, bad = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)), F.lit(0))).first()
        if not bad or bad == n:
            return {"weights": {}, "cuts": [20.0] * (GRADES - 1)}
        share = bad / n
        seen = counted.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("bad")).filter("df >= 3")
        z = (F.col("bad") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)) + 1e-9)
        telling = {r["word"]: r["z"] for r in seen.withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()}
        chosen = list(telling)
        place = {w: i for i, w in enumerate(chosen)}
        wanted = F.filter(F.arrays_zip("words", "counts"), lambda p: F.array_contains(F.lit(chosen) if chosen else F.array(F.lit("")), p["words"]))
        found = counted.select("grade", wanted.alias("w")).collect()  # about `sample` rows of at most `features` words
    finally:
        counted.unpersist()
    x, amount = np.zeros((len(found), len(chosen))), np.zeros(len(found))
    for i, r in enumerate(found):
        for word, c in r["w"]:
            x[i, place[word]] = 1 + np.log(c)
            amount[i] += c * (telling[word] > 0)
    grade = np.array([r["grade"] for r in found])
    grade[(grade > 0) & (amount > np.median(amount[grade > 0]))] = 2
    w, cuts = fit_ordinal(x, grade)
    return {"weights": dict(zip(chosen, w.tolist())), "cuts": cuts.tolist()}


class Judge:
    """Applies a model; keeps which features a word has, within bounds."""

    def __init__(self, model: dict):
        self.weights, self.cuts, self.known = model["weights"], np.array(model["cuts"]), {}

    def hits(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features_of(word) if f in self.weights)
        if len(word) <= LONG_WORD:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        counts: Counter = Counter()
        words = WORD.findall(text.lower()) if text else []
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.hits(w) if f is None else f for w, f in zip(words, found)]
        for f in filter(None, found):
            counts.update(f)
        z = sum(self.weights[f] * (1 + np.log(c)) for f, c in counts.items())
        return [float(1 / (1 + np.exp(-np.clip(z - t, -30, 30)))) for t in self.cuts]


def judge(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """Adds severity (expected grade), p_toxic and toxic (boolean) to docs; other columns of these names are replaced.

    A null or empty text has no feature and gets the prior. Rows keep their place: no shuffle.
    """
    names = without_names(docs, ("severity", "p_toxic", "toxic"))
    kept = undotted(docs.select(*named(*names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judge(model)
        for b in sliced(batches):
            p = [judged.above(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sum(x) for x in p], pa.float64()), pa.array([x[0] for x in p], pa.float64()), pa.array([x[0] >= cut for x in p], pa.bool_())], names=[*b.schema.names, "severity", "p_toxic", "toxic"])

    schema = T.StructType([*kept.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return kept.mapInArrow(run, schema).toDF(*names, "severity", "p_toxic", "toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "p_toxic", "toxic")
