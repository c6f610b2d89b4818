"""Queries: thresholds, ranking metrics, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import logit, sigmoid
from ..operators import calibrate as C
from ..operators import classify as K
from ..operators import splits
from ..sources import files
from .base import SCORES, r6, scores
from .registry import query

_CAND = f"{SCORES}, gr AS (SELECT cls, p, sum(y)::BIGINT AS g_pos, sum(1 - y)::BIGINT AS g_neg FROM sc GROUP BY 1, 2), cd AS (SELECT cls, p, g_pos, g_neg, (sum(g_pos) OVER d)::BIGINT AS tp, (sum(g_neg) OVER d)::BIGINT AS fp, (sum(g_pos) OVER a)::BIGINT AS pos, (sum(g_neg) OVER a)::BIGINT AS neg FROM gr WINDOW d AS (PARTITION BY cls ORDER BY p DESC), a AS (PARTITION BY cls))"
_YJ = f"{_CAND}, yk AS (SELECT cls, max(tp * neg - fp * pos) AS j FROM cd GROUP BY 1), yo AS (SELECT cd.cls, arg_max(p, (tp, p)) AS threshold, max(yk.j) AS j, count(*) AS n_tied, max(pos)::DOUBLE AS pos, max(neg)::DOUBLE AS neg FROM cd JOIN yk ON yk.cls = cd.cls AND tp * neg - fp * pos = yk.j WHERE yk.j > 0 GROUP BY 1)"


def cand(spark, sf):
    return K.candidates(scores(spark, sf), ["cls"])


@query("w4_candidate_table", f"WITH {_CAND} SELECT cls, p, tp, fp, pos, neg FROM cd")
def w4(spark, sf):
    return cand(spark, sf).select("cls", "p", "tp", "fp", "pos", "neg")


_CONF = f"{SCORES}, cf AS (SELECT cls, count(*) FILTER (p >= 0.6 AND y = 1) AS tp, count(*) FILTER (p >= 0.6 AND y = 0) AS fp, count(*) FILTER (p < 0.6 AND y = 0) AS tn, count(*) FILTER (p < 0.6 AND y = 1) AS fn FROM sc GROUP BY 1)"
_RATES = "tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


def conf(spark, sf):
    return K.confusion(scores(spark, sf), ["cls"], F.col("p") >= 0.6)


@query("g1_confusion", f"WITH {_CONF}, r AS (SELECT *, {_RATES} FROM cf) SELECT cls, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round((recall + specificity) / 2, 6) AS balanced FROM r")
def g1(spark, sf):
    return conf(spark, sf).select("cls", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "specificity", "f1", "balanced")])


@query("g2_macro_and_micro", f"WITH {_CONF}, r AS (SELECT *, {_RATES} FROM cf), m AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cf), q AS (SELECT {_RATES} FROM m) SELECT 'macro' AS kind, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(specificity), 6) AS specificity, round(avg(f1), 6) AS f1, count(precision)::BIGINT AS n_defined FROM r UNION ALL SELECT 'micro', round(precision, 6), round(recall, 6), round(specificity, 6), round(f1, 6), count(*) OVER () FROM q")
def g2(spark, sf):
    names = ("precision", "recall", "specificity", "f1")
    c = conf(spark, sf)
    macro = c.agg(*[r6(F.avg(n)).alias(n) for n in names], F.count("precision").alias("n_defined")).withColumn("kind", F.lit("macro"))
    pooled = c.agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "tn", "fn")])
    micro = pooled.select(*[r6(v).alias(k) for k, v in K.rates().items() if k in names], F.lit(1).cast("long").alias("n_defined"), F.lit("micro").alias("kind"))
    return macro.select("kind", *names, "n_defined").unionByName(micro)


@query("g3_auroc_auprc", f"WITH {_CAND} SELECT cls, round(sum(g_neg * (tp - g_pos + g_pos / 2.0::DOUBLE)) / max(pos * neg), 6) AS auroc, round(sum(g_pos * tp::DOUBLE / (tp + fp)) / max(pos), 6) AS auprc FROM cd GROUP BY 1")
def g3(spark, sf):
    return K.auc(cand(spark, sf), ["cls"]).select("cls", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query("g4_weighted_auc", _CAND.replace("em AS", "WITH em AS", 1).replace("sum(y)::BIGINT", "sum(y * (1 + vec_id % 3))::BIGINT").replace("sum(1 - y)::BIGINT", "sum((1 - y) * (1 + vec_id % 3))::BIGINT") + " SELECT cls, round(sum(g_neg * (tp - g_pos + g_pos / 2.0::DOUBLE)) / max(pos * neg), 6) AS auroc, round(sum(g_pos * tp::DOUBLE / nullif(tp + fp, 0)) / max(pos), 6) AS auprc FROM cd GROUP BY 1")
def g4(spark, sf):
    return K.auc(K.candidates(scores(spark, sf), ["cls"], 1 + F.col("vec_id") % 3), ["cls"]).select("cls", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query("g5_overcalling", f"WITH {SCORES}, r AS (SELECT vec_id, count(*) FILTER (p >= 0.6) AS n, bool_or(p >= 0.6 AND cls = 0) AND bool_or(p >= 0.6 AND cls > 0) AS contradiction FROM sc GROUP BY 1) SELECT round(avg(n), 6) AS mean_positives, count(*) FILTER (n = 0)::BIGINT AS without, count(*) FILTER (contradiction)::BIGINT AS contradictions, count(*)::BIGINT AS rows FROM r")
def g5(spark, sf):
    on = F.col("p") >= 0.6
    r = scores(spark, sf).groupBy("vec_id").agg(F.count_if(on).alias("n"), (F.bool_or(on & (F.col("cls") == 0)) & F.bool_or(on & (F.col("cls") > 0))).alias("c"))
    return r.agg(r6(F.avg("n")).alias("mean_positives"), F.count_if(F.col("n") == 0).alias("without"), F.count_if(F.col("c")).alias("contradictions"), F.count(F.lit(1)).alias("rows"))


@query("g6_histogram_overlap", f"WITH {SCORES}, h AS (SELECT cls, least(floor(p * 50), 49) AS bin, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM sc GROUP BY 1, 2), s AS (SELECT *, sum(a) OVER (PARTITION BY cls) AS sa, sum(b) OVER (PARTITION BY cls) AS sb FROM h) SELECT cls, round(sum(least(a / sa, b / sb)), 6) AS overlap FROM s GROUP BY 1")
def g6(spark, sf):
    h = scores(spark, sf).groupBy("cls", F.least(F.floor(F.col("p") * 50), F.lit(49)).alias("bin")).agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    total = h.groupBy("cls").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return h.join(total, "cls").groupBy("cls").agg(r6(F.sum(F.least(F.col("a") / F.col("sa"), F.col("b") / F.col("sb")))).alias("overlap"))


@query("g7_contradiction_breakdown", f"WITH {SCORES}, n AS (SELECT vec_id FROM sc WHERE cls = 0 AND p >= 0.6) SELECT cls, count(*)::BIGINT AS n FROM sc JOIN n USING (vec_id) WHERE cls > 0 AND p >= 0.6 GROUP BY 1")
def g7(spark, sf):
    on = scores(spark, sf).filter("p >= 0.6")
    return on.filter("cls > 0").join(on.filter("cls = 0").select("vec_id"), "vec_id", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("g8_youden_threshold", f"WITH {_YJ} SELECT cls, threshold, round(j / (pos * neg), 6) AS j, n_tied FROM yo")
def g8(spark, sf):
    return K.youden(cand(spark, sf), ["cls"]).filter("threshold is not null").select("cls", "threshold", r6("j").alias("j"), "n_tied")


@query("g9_f1_threshold", f"WITH {_CAND} SELECT cls, arg_max(p, (2.0::DOUBLE * tp / (tp + fp + pos), tp, p)) AS threshold, round(max(2.0::DOUBLE * tp / (tp + fp + pos)), 6) AS f1 FROM cd GROUP BY 1")
def g9(spark, sf):
    return K.f1_optimal(cand(spark, sf), ["cls"]).select("cls", "threshold", r6("f1").alias("f1"))


@query("g10_legacy_youden", f"WITH {_CAND} SELECT cls, arg_max(p, (tp * neg - fp * pos, p)) AS threshold FROM cd GROUP BY 1")
def g10(spark, sf):
    return K.youden(cand(spark, sf), ["cls"], legacy=True).select("cls", "threshold")


_Q = [round(0.05 * i, 2) for i in range(20)]


@query("g11_gate_selection", f"WITH {SCORES}, ps AS (SELECT cls, p, y, row_number() OVER (PARTITION BY cls ORDER BY p) AS r, count(*) OVER (PARTITION BY cls) AS n FROM sc WHERE p >= 0.5), gt AS (SELECT DISTINCT cls, p AS gate FROM ps, unnest({_Q}) u(q) WHERE r = floor((n - 1) * q) + 1), al AS (SELECT cls, sum(y)::BIGINT AS pos FROM sc GROUP BY 1), f AS (SELECT gt.cls, gate, sum(y)::BIGINT AS tp, count(*) AS kept, max(pos) AS pos FROM gt JOIN ps ON ps.cls = gt.cls AND ps.p >= gate JOIN al ON al.cls = gt.cls GROUP BY 1, 2), s AS (SELECT cls, gate, round(1.25::DOUBLE * tp / nullif(1.25::DOUBLE * tp + 0.25 * (pos - tp) + (kept - tp), 0), 12) AS f FROM f) SELECT cls, arg_max(gate, (f, -gate)) AS gate, round(max(f), 6) AS f FROM s GROUP BY 1")
def g11(spark, sf):
    return K.gate(scores(spark, sf).withColumn("positive", F.col("p") >= 0.5), ["cls"], _Q).select("cls", "gate", r6("f").alias("f"))


@query("h2_brier_and_log_loss", f"WITH {SCORES}, q AS (SELECT cls, y, p, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM sc) SELECT cls, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss FROM q GROUP BY 1")
def h2(spark, sf):
    c = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    return scores(spark, sf).groupBy("cls").agg(r6(F.avg((F.col("p") - F.col("y")) ** 2)).alias("brier"), r6(-F.avg(F.when(F.col("y") == 1, F.log(c)).otherwise(F.log1p(-c)))).alias("log_loss"))


_BINS = f"{SCORES}, nt AS (SELECT *, ntile(10) OVER (PARTITION BY cls ORDER BY p, vec_id) AS bin FROM sc), bn AS (SELECT cls, bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob, sum(y)::BIGINT AS np FROM nt GROUP BY 1, 2)"


@query("h3_reliability_bins", f"WITH {_BINS} SELECT cls, bin, n, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed, np AS n_positive FROM bn")
def h3(spark, sf):
    return K.reliability(scores(spark, sf), ["cls"], "vec_id").select("cls", F.col("bin").cast("long").alias("bin"), "n", r6("mean_predicted").alias("mean_predicted"), r6("observed").alias("observed"), "n_positive")


@query("h4_adaptive_ece", f"WITH {_BINS} SELECT cls, round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece FROM bn GROUP BY 1")
def h4(spark, sf):
    return K.ece(K.reliability(scores(spark, sf), ["cls"], "vec_id"), ["cls"]).select("cls", r6("ece").alias("ece"))


_PT = f"{SCORES}, pt AS (SELECT cls, p, ln(p) - ln(1 - p) AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM sc GROUP BY 1, 2)"
# The optimum by plain Newton steps from the start; both losses are convex.
_PLATT = f"""{_PT}, nw(cls, a, b, k) AS (SELECT DISTINCT cls, 1.0::DOUBLE, 0.0::DOUBLE, 0 FROM pt UNION ALL SELECT cls, a - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10), b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10), k + 1 FROM
(SELECT cls, a, b, k, sum((q * n - pos) * z) AS g1, sum(q * n - pos) AS g0, sum(q * (1 - q) * n * z * z) AS h11, sum(q * (1 - q) * n * z) AS h10, sum(q * (1 - q) * n) AS h00 FROM (SELECT nw.*, z, n, pos, 1 / (1 + exp(-(a * z + b))) AS q FROM nw JOIN pt USING (cls) WHERE k < 30) GROUP BY 1, 2, 3, 4))"""
_TEMP = f"""{_PT}, nw(cls, s, k) AS (SELECT DISTINCT cls, 1.0::DOUBLE, 0 FROM pt UNION ALL SELECT cls, s - g / h, k + 1 FROM (SELECT cls, s, k, sum((q * n - pos) * z) AS g, sum(q * (1 - q) * n * z * z) AS h FROM (SELECT nw.*, z, n, pos, 1 / (1 + exp(-s * z)) AS q FROM nw JOIN pt USING (cls) WHERE k < 30) GROUP BY 1, 2, 3)),
be AS (SELECT cls, least(greatest(CASE WHEN s > 0 THEN 1 / s ELSE 20 END, 0.05), 20) AS t FROM nw WHERE k = 30)"""


@query("h5_calibration_slope", f"WITH RECURSIVE {_PLATT} SELECT cls, round(a, 6) AS slope, round(b, 6) AS intercept FROM nw WHERE k = 30")
def h5(spark, sf):
    return C.fit_platt(C.compact(scores(spark, sf))).select("cls", r6("a").alias("slope"), r6("b").alias("intercept"))


@query("h6_temperature_fit", f"WITH RECURSIVE {_TEMP} SELECT cls, round(max(t), 4) AS t, round(-sum(pos * ln(1 / (1 + exp(-z / t))) + (n - pos) * ln(1 - 1 / (1 + exp(-z / t)))) / sum(n), 6) AS nll, max(t) <= 0.05 * 1.001 OR max(t) >= 20 * 0.999 AS at_edge FROM be JOIN pt USING (cls) GROUP BY 1")
def h6(spark, sf):
    return C.fit_temperature(C.compact(scores(spark, sf)), 9).select("cls", r6("t", 4).alias("t"), r6("nll").alias("nll"), "at_edge")


@query("h7_platt_fit", f"WITH RECURSIVE {_PLATT} SELECT cls, round(a, 6) AS a, round(b, 6) AS b, true AS converged, CASE WHEN a <= 0 THEN 'non_positive_slope' ELSE '' END AS flags FROM nw WHERE k = 30")
def h7(spark, sf):
    return C.fit_platt(C.compact(scores(spark, sf))).select("cls", r6("a").alias("a"), r6("b").alias("b"), "converged", "flags")


# The non-decreasing fit at a point is the largest of the smallest means of runs around it.
_ISO = f"""{_PT}, ip AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM pt WINDOW w AS (PARTITION BY cls ORDER BY p)), pr AS (SELECT a.cls, a.i AS j, b.i AS k, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM ip a JOIN ip b ON a.cls = b.cls AND a.i <= b.i),
mn AS (SELECT cls, j, k AS i, min(m) OVER (PARTITION BY cls, j ORDER BY k DESC) AS m FROM pr), ft AS (SELECT cls, i, max(m) AS f FROM mn GROUP BY 1, 2), bl AS (SELECT ft.cls, round(f, 9) AS g, max(f) AS f, min(z) AS lo, max(z) AS hi FROM ft JOIN ip ON ip.cls = ft.cls AND ip.i = ft.i GROUP BY 1, 2)"""


@query("h8_isotonic_fit", f"WITH {_ISO} SELECT cls, round(lo, 6) AS x, round(f, 6) AS y FROM bl UNION ALL SELECT cls, round(hi, 6), round(f, 6) FROM bl WHERE hi > lo")
def h8(spark, sf):
    return C.fit_isotonic(C.compact(scores(spark, sf))).select("cls", r6("x").alias("x"), r6("y").alias("y"))


_A, _B0 = 1.7, -0.4


@query("h9_apply_calibrator", f"WITH {SCORES}, z AS (SELECT vec_id, cls, p, {_A} * (ln(p) - ln(1 - p)) + ({_B0}) AS z FROM sc) SELECT vec_id, cls, round(1 / (1 + exp(-z)), 6) AS q, (p >= 0.6) <> (1 / (1 + exp(-z)) >= 1 / (1 + exp(-({_A} * (ln(0.6) - ln(0.4)) + ({_B0}))))) AS flipped FROM z")
def h9(spark, sf):
    q = sigmoid(_A * logit(F.col("p")) + _B0)
    cut = sigmoid(_A * logit(F.lit(0.6)) + _B0)
    return scores(spark, sf).select("vec_id", "cls", r6(q).alias("q"), ((F.col("p") >= 0.6) != (q >= cut)).alias("flipped"))


@query("h10_method_comparison")
def h10(spark, sf):
    """Out-of-fold losses and guardrails of raw, temperature, Platt and isotonic scores, and the method chosen for each class."""
    s = files.written(scores(spark, sf).withColumn("fold", splits.folds(F.col("vec_id"), 3)), "scores")
    x = files.written(C.out_of_fold(s, 3, 0.6), "compared")
    return C.choose(x).withColumn("log_loss", r6("log_loss")).withColumn("brier", r6("brier"))
