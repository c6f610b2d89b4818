"""Metrics of generated text against references and sources."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import ngrams

EPS = 0.1


def ngram_matches(pairs: DataFrame, n: int) -> DataFrame:
    """id, total, match: n-grams of the hypothesis and how many of them the reference has (clipped). pairs: id, h, r (token
    arrays)."""
    side = lambda c: pairs.select("id", F.explode(ngrams(F.col(c), n)).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    x = side("h").join(side("r"), ["id", "g"], "left")
    return x.groupBy("id").agg(F.sum("n_h").alias("total"), F.sum(F.least("n_h", F.coalesce("n_r", F.lit(0)))).alias("match"))


def bleu(pairs: DataFrame, max_n: int) -> DataFrame:
    """id, bleu: geometric mean of clipped precisions (a zero match counts EPS) with brevity penalty; 0 if a side is empty or too
    short for max_n."""
    out = pairs.select("id", F.size("h").cast("double").alias("lh"), F.size("r").cast("double").alias("lr"))
    for n in range(1, max_n + 1):
        m = ngram_matches(pairs, n).select("id", F.log(F.when(F.col("match") > 0, F.col("match").cast("double")).otherwise(EPS) / F.col("total")).alias(f"p{n}"))
        out = out.join(m, "id", "left")
    mean = sum(F.col(f"p{n}") for n in range(1, max_n + 1)) / max_n
    penalty = F.when(F.col("lh") > F.col("lr"), 0.0).otherwise(1 - F.try_divide("lr", "lh"))
    return out.select("id", F.when((F.col("lr") > 0) & mean.isNotNull(), F.exp(mean + penalty)).otherwise(0.0).alias("bleu"))


def common_length(a, b) -> int:
    """Length of the longest common subsequence. A row of the table is one number, whose zero bits are the places where the length grows; a
    row follows from the last one by one addition, so a text costs a step for each token of the shorter one."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    places: dict[str, int] = {}
    for i, w in enumerate(long_):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(long_)) - 1
    row = full
    for w in short:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(long_) - row.bit_count()


@pandas_udf(DoubleType())
def rouge_l(h: pd.Series, r: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays."""

    def one(a, b) -> float:
        if a is None or b is None or not len(a) or not len(b):
            return 0.0
        return 2 * common_length(a, b) / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(h, r)])


@pandas_udf(DoubleType())
def meteor_exact(h: pd.Series, r: pd.Series) -> pd.Series:
    """Exact-match METEOR: each hypothesis token takes the first free equal reference token; alpha 0.9, beta 3, gamma 0.5."""

    def one(a, b) -> float:
        if a is None or b is None or not len(a) or not len(b):
            return 0.0
        free: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            free.setdefault(b[j], []).append(j)
        pairs = [(i, free[w].pop()) for i, w in enumerate(a) if free.get(w)]
        if not pairs:
            return 0.0
        m = len(pairs)
        p, rc = m / len(a), m / len(b)
        breaks = sum(i2 != i1 + 1 or j2 != j1 + 1 for (i1, j1), (i2, j2) in zip(pairs, pairs[1:]))
        return p * rc / (0.9 * p + 0.1 * rc) * (1 - 0.5 * ((1 + breaks) / m) ** 3)

    return pd.Series([one(a, b) for a, b in zip(h, r)])


def _grams(t, n: int) -> Counter:
    return Counter(zip(*(t[i:] for i in range(n))))


@pandas_udf(StructType([*(StructField(c, DoubleType()) for c in ("bleu1", "bleu4")), *(StructField(c, LongType()) for c in ("n_long", "n_copied")), StructField("overlap_rate", DoubleType())]))
def overlaps(h: pd.Series, r: pd.Series, hs: pd.Series, rs: pd.Series) -> pd.DataFrame:
    """What `bleu` (for 1 and 4) and `copy_statistics` say of a text and its one source, in the row that holds both: tokens, tokens of the
    source, and the normalised sentences of each."""

    def one(a, b, said, source) -> tuple:
        a, b = list(a), list(b)
        logs, bleus = [], []
        for n in range(1, 5):
            x, y = _grams(a, n), _grams(b, n)
            match = sum(min(c, y[g]) for g, c in x.items())
            logs.append(math.log((match or EPS) / (len(a) - n + 1)) if len(a) >= n else None)
        for n in (1, 4):
            penalty = 0.0 if len(a) > len(b) else 1 - len(b) / max(len(a), 1)
            bleus.append(math.exp(sum(logs[:n]) / n + penalty) if len(b) and None not in logs[:n] else 0.0)
        long_, have = [s for s in said if s.count(" ") + 1 >= 6], set(source)
        x, y = _grams(a, 8), _grams(b, 8)
        overlap = sum(c for g, c in x.items() if g in y) / (len(a) - 7) if len(a) >= 8 else 0.0
        return *bleus, len(long_), sum(s in have for s in long_), overlap

    return pd.DataFrame([one(*x) for x in zip(h, r, hs, rs)], columns=["bleu1", "bleu4", "n_long", "n_copied", "overlap_rate"])


def repeat_rate(sentences: Column) -> Column:
    """Share of normalised sentences that repeat another; 0 without any."""
    s = F.filter(sentences, lambda x: x != "")
    return F.when(F.size(s) > 0, 1 - F.size(F.array_distinct(s)) / F.size(s)).otherwise(0.0)


def copy_statistics(generated: DataFrame, sources: DataFrame, min_words: int = 6, n: int = 8) -> DataFrame:
    """id, n_long, n_copied, copied_rate, overlap_rate, whole_copy. generated, sources: id, sentences (normalised), tokens;
    a text's sources are the rows of the same id."""
    long_ = generated.select("id", F.explode("sentences").alias("s")).filter(F.size(F.split("s", " ")) >= min_words)
    have = sources.select("id", F.explode("sentences").alias("s")).distinct().withColumn("hit", F.lit(1))
    a = long_.join(have, ["id", "s"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_long"), F.count("hit").alias("n_copied"))
    grams = generated.select("id", F.explode(ngrams(F.col("tokens"), n)).alias("g"))
    known = sources.select("id", F.explode(ngrams(F.col("tokens"), n)).alias("g")).distinct().withColumn("hit", F.lit(1))
    b = grams.join(known, ["id", "g"], "left").groupBy("id").agg((F.count("hit") / F.count(F.lit(1))).alias("overlap"))
    x = generated.select("id").join(a, "id", "left").join(b, "id", "left")
    nl, nc = F.coalesce("n_long", F.lit(0)), F.coalesce("n_copied", F.lit(0))
    return x.select("id", nl.alias("n_long"), nc.alias("n_copied"), F.coalesce(F.try_divide(nc.cast("double"), nl.cast("double")), F.lit(0.0)).alias("copied_rate"), F.coalesce("overlap", F.lit(0.0)).alias("overlap_rate"), ((nl > 0) & (nl == nc)).alias("whole_copy"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    d = [c.cast("double") for c in (tp, fp, fn)]
    return {"precision": F.try_divide(d[0], d[0] + d[1]), "recall": F.try_divide(d[0], d[0] + d[2]), "f1": F.try_divide(2 * d[0], 2 * d[0] + d[1] + d[2])}
