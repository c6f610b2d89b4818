"""Multi-label association and imbalance, on long (id, label) membership rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cardinality(members: DataFrame, n_rows: int | None, ids: DataFrame) -> DataFrame:
    """One row: rows, cardinality (mean labels a row), density (over the labels that occur)."""
    n = ids.agg(F.count(F.lit(1)).alias("rows"))
    m = members.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("label").alias("labels"))
    return n.join(F.broadcast(m)).select("rows", F.round(F.col("cells") / F.col("rows"), 6).alias("cardinality"), F.round(F.try_divide(F.col("cells") / F.col("rows"), F.col("labels").cast("double")), 6).alias("density"))  # one row


def positives_per_row(members: DataFrame, ids: DataFrame) -> DataFrame:
    """labels_per_row, n."""
    k = ids.join(members.groupBy("id").count(), "id", "left").select(F.coalesce("count", F.lit(0)).alias("labels_per_row"))
    return k.groupBy("labels_per_row").agg(F.count(F.lit(1)).alias("n"))


def pairwise(members: DataFrame, ids: DataFrame) -> DataFrame:
    """a, b, n_ab, n_a, n_b, jaccard, p_b_given_a, phi, lift for all label pairs a <> b; undefined measures are null.

    Counts come from one self-join on id; the label table is tiny, so the zero pairs are filled in from it.
    """
    singles = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = ids.agg(F.count(F.lit(1)).cast("double").alias("rows"))
    pairs = members.select("id", F.col("label").alias("a")).join(members.select("id", F.col("label").alias("b")), "id").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    every = singles.select(F.col("label").alias("a"), F.col("n").alias("n_a")).join(F.broadcast(singles.select(F.col("label").alias("b"), F.col("n").alias("n_b"))), F.col("a") != F.col("b")).join(F.broadcast(total))  # labels x labels
    x = every.join(pairs, ["a", "b"], "left").withColumn("n_ab", F.coalesce("k", F.lit(0)))
    d = {c: F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b")}
    rows = F.col("rows")
    spread = F.sqrt(d["n_a"] * (rows - d["n_a"]) * d["n_b"] * (rows - d["n_b"]))
    return x.select(
        "a", "b", "n_ab", "n_a", "n_b",
        F.round(F.try_divide(d["n_ab"], d["n_a"] + d["n_b"] - d["n_ab"]), 6).alias("jaccard"),
        F.round(F.try_divide(d["n_ab"], d["n_a"]), 6).alias("p_b_given_a"),
        F.round(F.try_divide(rows * d["n_ab"] - d["n_a"] * d["n_b"], spread), 6).alias("phi"),
        F.round(F.try_divide(rows * d["n_ab"], d["n_a"] * d["n_b"]), 6).alias("lift"),
    )


def pos_weight(long: DataFrame, fallback: float = 1.0) -> DataFrame:
    """label, n_pos, n_neg, pos_weight, degenerate; long: label, target, mask (0/1)."""
    g = long.groupBy("label").agg(F.sum(F.when((F.col("mask") == 1) & (F.col("target") == 1), 1).otherwise(0)).alias("n_pos"), F.sum(F.when((F.col("mask") == 1) & (F.col("target") == 0), 1).otherwise(0)).alias("n_neg"))
    bad = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return g.select("label", "n_pos", "n_neg", F.round(F.when(bad, F.lit(fallback)).otherwise(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double"))), 6).alias("pos_weight"), bad.alias("degenerate"))


def sampling_weights(members: DataFrame, ids: DataFrame, how: str = "max") -> DataFrame:
    """id, w: inverse prevalence of a row's labels (their max, mean or the root of the max); rows without a label form a group
    with its own prevalence."""
    rows = ids.agg(F.count(F.lit(1)).cast("double").alias("rows"))
    share = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rows)).select("label", (F.col("rows") / F.col("n")).alias("inverse"))
    own = members.join(F.broadcast(share), "label").groupBy("id").agg((F.avg("inverse") if how == "mean" else F.max("inverse")).alias("w"))  # share: a row for each label
    none = ids.join(members.select("id").distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(rows)).select(F.try_divide(F.col("rows"), F.col("k").cast("double")).alias("w_none"))
    w = ids.join(own, "id", "left").join(F.broadcast(none)).select("id", F.coalesce("w", "w_none").alias("w"))
    return w.select("id", F.sqrt("w").alias("w")) if how == "sqrt_max" else w


def sampler_effect(members: DataFrame, weights: DataFrame) -> DataFrame:
    """label, prevalence, expected (under the weights), ess (Kish effective sample size)."""
    t = weights.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.count(F.lit(1)).cast("double").alias("rows"))
    g = members.join(weights, "id").groupBy("label").agg(F.sum("w").alias("lw"), F.count(F.lit(1)).cast("double").alias("n"))
    return g.join(F.broadcast(t)).select("label", F.round(F.col("n") / F.col("rows"), 6).alias("prevalence"), F.round(F.col("lw") / F.col("sw"), 6).alias("expected"), F.round(F.col("sw") * F.col("sw") / F.col("sww"), 3).alias("ess"))  # one row
