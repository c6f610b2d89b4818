"""Ranking and threshold metrics on long score rows (cls, y, p, optional weight w). Undefined values are null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import ordered


def candidates(rows: DataFrame, by: list[str], w: Column | None = None, share: int = ordered.SHARE) -> DataFrame:
    """by, p, tp, fp, pos, neg: cumulative counts at each distinct score, highest first. Scores are summed up, and written, before
    anything is ordered; classes of very many distinct scores are summed range by range."""
    w = F.lit(1) if w is None else w
    g = rows.groupBy(*by, "p").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("g_pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("g_neg"))
    r = ordered.running(files.written(g, "scores"), by, "p", ["g_pos", "g_neg"], share)
    down = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    return r.select(*by, "p", "g_pos", "g_neg", down("g_pos").alias("tp"), down("g_neg").alias("fp"), F.col("g_pos_all").alias("pos"), F.col("g_neg_all").alias("neg"))


def auc(cand: DataFrame, by: list[str]) -> DataFrame:
    """by, auroc, auprc."""
    d = lambda c: F.col(c).cast("double")
    above = d("tp") - d("g_pos")
    g = cand.groupBy(*by).agg(F.sum(d("g_neg") * (above + d("g_pos") / 2)).alias("area"), F.sum(d("g_pos") * d("tp") / (d("tp") + d("fp"))).alias("ap"), F.max("pos").cast("double").alias("pos"), F.max("neg").cast("double").alias("neg"))
    ok = (F.col("pos") > 0) & (F.col("neg") > 0)
    return g.select(*by, F.when(ok, F.try_divide(F.col("area"), F.col("pos") * F.col("neg"))).alias("auroc"), F.when(ok, F.try_divide("ap", "pos")).alias("auprc"))


def youden(cand: DataFrame, by: list[str], legacy: bool = False) -> DataFrame:
    """by, threshold, j, n_tied: the largest J > 0 in exact integers; ties to higher sensitivity, then the higher score (legacy:
    the higher score at once). Null where no score beats chance."""
    j = F.col("tp") * F.col("neg") - F.col("fp") * F.col("pos")
    g = ordered.largest_by(cand, by, j, F.struct((F.lit(0) if legacy else F.col("tp")).cast("long").alias("t"), "p", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg")))
    ok = F.col("key") > 0
    return g.select(*by, F.when(ok, F.col("then.p")).alias("threshold"), F.when(ok, F.col("key") / (F.col("then.pos") * F.col("then.neg"))).alias("j"), F.when(ok, F.col("n_tied")).alias("n_tied"))


def f1_optimal(cand: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, f1: ties to higher recall, then the higher score."""
    f1 = F.try_divide(2.0 * F.col("tp"), (F.col("tp") + F.col("fp") + F.col("pos")).cast("double"))
    g = cand.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), F.col("tp").alias("t"), "p")).alias("k"))
    return g.select(*by, F.when(F.col("k.t") > 0, F.col("k.p")).alias("threshold"), F.when(F.col("k.t") > 0, F.col("k.f1")).alias("f1"))


def confusion(rows: DataFrame, by: list[str], decision: Column, w: Column | None = None) -> DataFrame:
    """by, tp, fp, tn, fn and precision, recall, specificity, f1, balanced accuracy."""
    w = F.lit(1) if w is None else w
    y = F.col("y") == 1
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    g = rows.groupBy(*by).agg(n(decision & y).alias("tp"), n(decision & ~y).alias("fp"), n(~decision & ~y).alias("tn"), n(~decision & y).alias("fn"))
    return g.select(*by, "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in rates().items()])


def rates() -> dict[str, Column]:
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")}
    recall, specificity = F.try_divide(d["tp"], d["tp"] + d["fn"]), F.try_divide(d["tn"], d["tn"] + d["fp"])
    return {"precision": F.try_divide(d["tp"], d["tp"] + d["fp"]), "recall": recall, "specificity": specificity, "f1": F.try_divide(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"]), "balanced": (recall + specificity) / 2}


def gate(rows: DataFrame, by: list[str], quantiles: list[float], beta: float = 0.5, share: int = ordered.SHARE) -> DataFrame:
    """by, gate, f: among quantiles (method lower) of the scores of positive decisions, the one with the highest F-beta, ties to
    the least strict. rows: by, y, p, positive. Recall counts all positives."""
    pos = rows.filter("positive")
    per = pos.groupBy(*by, "p").agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("k"))
    c = ordered.running(files.written(per, "scores"), by, "p", ["tp", "k"], share)
    down = lambda v: F.col(f"{v}_all") - F.col(f"{v}_upto") + F.col(v)
    c = c.select(*by, "p", F.col("k_upto").alias("upto"), "k", down("tp").alias("tp"), down("k").alias("kept"), F.col("k_all").alias("n"))
    hit = F.exists(F.array(*map(F.lit, quantiles)), lambda q: (F.floor((F.col("n") - 1) * q) + 1 <= F.col("upto")) & (F.floor((F.col("n") - 1) * q) + 1 > F.col("upto") - F.col("k")))
    total = rows.groupBy(*by).agg(F.sum("y").alias("all_pos"))
    b2 = beta * beta
    f = F.try_divide((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * (F.col("all_pos") - F.col("tp")) + (F.col("kept") - F.col("tp")))
    best = c.filter(hit).join(total, by).groupBy(*by).agg(F.max(F.struct(F.round(f, 12).alias("f"), (-F.col("p")).alias("m"))).alias("k"))
    return best.select(*by, (-F.col("k.m")).alias("gate"), F.col("k.f").alias("f"))


def reliability(rows: DataFrame, by: list[str], order: str, bins: int = 10, share: int = ordered.SHARE) -> DataFrame:
    """by, bin, n, mean_predicted, observed, n_positive: bins of equal numbers in score order (ties by `order`, numeric), the first ones
    larger by one. A row's rank is the number of rows with lower scores, from sums by distinct score, and its place among equal
    scores; no task sorts a whole class, nor more than `share` equal scores."""
    kept = files.written(rows.select(*by, "p", "y", order), "rows")
    per = files.written(kept.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("k")), "scores")
    before = ordered.running(per, by, "p", ["k"], share).select(*by, "p", (F.col("k_upto") - F.col("k")).alias("before"), F.col("k_all").alias("total"))
    ranked = ordered.attach(ordered.numbered(kept, [*by, "p"], order, share).drop("n_all"), before, [*by, "p"]).withColumn("rank", F.col("before") + F.col("n_th"))
    size, more = F.floor(F.col("total") / bins), F.col("total") % bins
    head = (size + 1) * more
    b = ranked.withColumn("bin", F.when(F.col("rank") <= head, F.ceil(F.col("rank") / (size + 1))).otherwise(more + F.ceil(F.try_divide((F.col("rank") - head).cast("double"), size.cast("double")))).cast("int"))
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("observed"), F.sum("y").alias("n_positive"))


def ece(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))
