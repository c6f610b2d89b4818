"""Fitting and applying calibrators for many classes at once.

Fits work on distinct scores with their counts (cls, z, n, pos), a table that does not grow with the rows beyond the precision
of the scores; each iteration is one aggregate over it, with the parameters of all classes joined on.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import logit, sigmoid
from ..sources import files
from . import ordered

T_BOUNDS = (0.05, 20.0)


def compact(rows: DataFrame) -> DataFrame:
    """cls, z, n, pos from cls, y, p."""
    return rows.groupBy("cls", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).select("cls", logit(F.col("p")).alias("z"), "p", "n", "pos")


def _nll(z: Column) -> Column:
    p = F.least(F.greatest(sigmoid(z), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(F.col("pos") * F.log(p) + (F.col("n") - F.col("pos")) * F.log1p(-p))


def fit_temperature(points: DataFrame, rounds: int = 6, width: int = 24) -> DataFrame:
    """cls, t, nll, at_edge: the temperature of least loss. Every round tries `width` temperatures of each class in one pass and
    narrows to the neighbours of the best."""
    spark = points.sparkSession
    span = {r["cls"]: (math.log(T_BOUNDS[0]), math.log(T_BOUNDS[1])) for r in points.select("cls").distinct().collect()}  # a row for each class
    points = points.persist()
    best: dict[int, tuple[float, float]] = {}
    for _ in range(rounds):
        grid = spark.createDataFrame([(c, lo + (hi - lo) * i / (width - 1)) for c, (lo, hi) in span.items() for i in range(width)], "cls int, lt double")
        tried = points.join(F.broadcast(grid), "cls").groupBy("cls", "lt").agg((F.sum(_nll(F.col("z") / F.exp("lt"))) / F.sum("n")).alias("nll"))
        for r in tried.groupBy("cls").agg(F.min(F.struct("nll", "lt")).alias("m")).collect():
            lo, hi = span[r["cls"]]
            step = (hi - lo) / (width - 1)
            best[r["cls"]] = (r["m"]["lt"], r["m"]["nll"])
            span[r["cls"]] = (max(math.log(T_BOUNDS[0]), r["m"]["lt"] - step), min(math.log(T_BOUNDS[1]), r["m"]["lt"] + step))
    points.unpersist()
    rows = [(c, math.exp(lt), nll, bool(math.exp(lt) <= T_BOUNDS[0] * 1.001 or math.exp(lt) >= T_BOUNDS[1] * 0.999)) for c, (lt, nll) in best.items()]
    return spark.createDataFrame(rows, "cls int, t double, nll double, at_edge boolean")


def fit_platt(points: DataFrame, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """cls, a, b, converged, flags: logistic regression on the logit by damped Newton steps, all classes together."""
    spark = points.sparkSession
    points = points.persist()
    at = {r["cls"]: (1.0, 0.0) for r in points.select("cls").distinct().collect()}
    loss: dict[int, float] = {}
    step: dict[int, tuple[float, float]] = {c: (0.0, 0.0) for c in at}
    damp = {c: 1.0 for c in at}
    done: set[int] = set()
    for _ in range(rounds):
        trial = {c: (a - damp[c] * step[c][0], b - damp[c] * step[c][1]) for c, (a, b) in at.items() if c not in done}
        if not trial:
            break
        params = spark.createDataFrame([(c, a, b) for c, (a, b) in trial.items()], "cls int, a double, b double")
        z = F.col("a") * F.col("z") + F.col("b")
        p = sigmoid(z)
        w, e = p * (1 - p) * F.col("n"), p * F.col("n") - F.col("pos")
        sums = points.join(F.broadcast(params), "cls").groupBy("cls").agg(F.sum("n").alias("n"), F.sum(_nll(z)).alias("nll"), F.sum(e * F.col("z")).alias("g1"), F.sum(e).alias("g0"), F.sum(w * F.col("z") * F.col("z")).alias("h11"), F.sum(w * F.col("z")).alias("h10"), F.sum(w).alias("h00")).collect()
        for r in sums:
            c, n = r["cls"], r["n"]
            if c in loss and r["nll"] / n > loss[c] + 1e-14 and damp[c] > 1e-8:
                damp[c] /= 2
                continue
            at[c], loss[c], damp[c] = trial[c], r["nll"] / n, 1.0
            g1, g0, h11, h10, h00 = (r[k] / n for k in ("g1", "g0", "h11", "h10", "h00"))
            if max(abs(g1), abs(g0)) < tolerance:
                done.add(c)
                continue
            h11, h00 = h11 + 1e-12, h00 + 1e-12
            det = h11 * h00 - h10 * h10
            step[c] = ((h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det)
    points.unpersist()
    flags = lambda c, a: ";".join(["not_converged"] * (c not in done) + ["non_positive_slope"] * (a <= 0))
    return spark.createDataFrame([(c, a, b, c in done, flags(c, a)) for c, (a, b) in at.items()], "cls int, a double, b double, converged boolean, flags string")


def _pool(b: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks merged until their means rise."""
    b = b.sort_values("lo")
    kept: list[list[float]] = []  # n, pos, lo, hi
    for n, pos, lo, hi in zip(b["n"], b["pos"], b["lo"], b["hi"]):
        kept.append([n, pos, lo, hi])
        while len(kept) > 1 and kept[-2][1] * kept[-1][0] >= kept[-1][1] * kept[-2][0]:
            n2, pos2, _, last = kept.pop()
            head = kept[-1]
            head[0], head[1], head[3] = head[0] + n2, head[1] + pos2, last
    n, pos, lo, hi = zip(*kept)
    return pd.DataFrame({"cls": b["cls"].iloc[0], "lo": lo, "hi": hi, "n": n, "pos": pos})


def fit_isotonic(points: DataFrame, share: int = ordered.SHARE) -> DataFrame:
    """cls, x, y: knots of the non-decreasing fit by pooling adjacent violators, over each class's distinct scores.

    Chunks of `share` neighbouring blocks are pooled each by itself, and again with chunks that begin half-way, until two rounds in a row
    merge nothing: then every two neighbours have been in one chunk and rise. The order of merges does not change the fit.
    A class of at most `share` blocks is one chunk, and done in one round.
    """
    blocks = files.written(points.select("cls", F.col("z").alias("lo"), F.col("z").alias("hi"), F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos")), "blocks")
    before, half, calm = None, False, 0
    while calm < 2:
        most = ordered.largest(blocks, ["cls"])
        start = share // 2 if half and most > share else 0
        chunk = F.floor((F.col("n_th") - 1 + start) / share)
        dealt = ordered.numbered(blocks, ["cls"], "lo", share).withColumn("chunk", chunk)
        pooled = files.written(dealt.groupBy("cls", "chunk").applyInPandas(_pool, "cls int, lo double, hi double, n double, pos double"), "blocks")
        files.discard(blocks)
        blocks = pooled
        if most <= share:
            break
        left = blocks.count()
        calm = calm + 1 if left == before else 0
        before, half = left, not half
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select("cls", F.explode(ends).alias("x"), (F.col("pos") / F.col("n")).alias("y"))


def apply_isotonic(rows: DataFrame, knots: DataFrame, eps: float = 1e-6, share: int = ordered.SHARE) -> DataFrame:
    """Adds q, linear between knots and flat outside, by an as-of join. rows: cls, z; those of classes without knots are left out."""
    q = ordered.interpolated(rows, knots, ["cls"], "z", share)
    return q.withColumn("q", F.least(F.greatest("q", F.lit(eps)), F.lit(1 - eps)))


#: Fixed values of the choice among methods: how far from the best a simpler one may be, for how many classes a method must be chosen to be
#: taken for all, and what that may cost any of them.
TOLERANCE, UNIFORM_CLASSES, UNIFORM_LOSS = 0.005, 10 / 14, 0.01
COMPLEXITY = ["raw", "temperature", "platt", "isotonic"]


def out_of_fold(rows: DataFrame, folds: int, threshold: float) -> DataFrame:
    """cls, method, log_loss, brier, pathological, mismatches. rows: cls, y, p, fold.

    Losses are of calibrators fitted on the other folds. Guardrails: fits that are pathological (at an edge, not converged,
    falling) in any fold or on all rows, and decisions at the threshold that the calibrator of all rows would change.
    """
    z = logit(F.col("p"))
    fits = []
    for k in [*range(folds), None]:
        points = compact(rows if k is None else rows.filter(F.col("fold") != k))
        t, ab = fit_temperature(points, 4, 16), fit_platt(points, 20)
        both = t.select("cls", "t", "at_edge").join(ab.select("cls", "a", "b", "flags"), "cls")
        test = (rows if k is None else rows.filter(F.col("fold") == k)).withColumn("z", z).join(F.broadcast(both), "cls")  # a row for each class
        iso = fit_isotonic(points)
        iso = files.written(iso, "knots")
        at_cut = apply_isotonic(iso.select("cls").distinct().withColumn("z", logit(F.lit(threshold))), iso).select("cls", F.col("q").alias("iso_cut"))
        test = apply_isotonic(test, iso).withColumnRenamed("q", "iso").join(F.broadcast(at_cut), "cls")  # a row for each class
        cut = logit(F.lit(threshold))
        of = {"raw": (F.col("p"), F.lit(threshold), F.lit(False)), "temperature": (sigmoid(F.col("z") / F.col("t")), sigmoid(cut / F.col("t")), F.col("at_edge")), "platt": (sigmoid(F.col("a") * F.col("z") + F.col("b")), sigmoid(F.col("a") * cut + F.col("b")), F.col("flags") != ""), "isotonic": (F.col("iso"), F.col("iso_cut"), F.lit(False))}
        each = F.array(*[F.struct(F.lit(m).alias("method"), q.alias("q"), bad.alias("bad"), ((F.col("p") >= threshold) != (q >= c)).alias("changed")) for m, (q, c, bad) in of.items()])
        fits.append(test.select("cls", "y", F.lit(k is None).alias("full"), F.explode(each).alias("m")).select("cls", "y", "full", "m.*"))
    every = fits[0]
    for f in fits[1:]:
        every = every.unionByName(f)
    c = F.least(F.greatest("q", F.lit(1e-15)), F.lit(1 - 1e-15))
    held = ~F.col("full")
    return every.groupBy("cls", "method").agg(
        (-F.avg(F.when(held, F.when(F.col("y") == 1, F.log(c)).otherwise(F.log1p(-c))))).alias("log_loss"), F.avg(F.when(held, (F.col("q") - F.col("y")) ** 2)).alias("brier"),
        F.bool_or("bad").alias("pathological"), F.count_if(F.col("full") & F.col("changed")).alias("mismatches"),
    )


def choose(compared: DataFrame, tolerance: float = TOLERANCE, share: float = UNIFORM_CLASSES, most_loss: float = UNIFORM_LOSS) -> DataFrame:
    """compared (columns of out_of_fold) with eligible, own (the class's choice) and chosen added, a row each.

    Eligible: no guardrail broken. A class's choice is the simplest eligible method within the tolerance of the best eligible log
    loss and Brier score, else the one of least log loss; null if none is eligible. The method most classes choose (ties: the
    simpler) is taken for all if that many choose it, every class may have it, and none loses more than most_loss by it.
    """
    order = F.array_position(F.array(*map(F.lit, COMPLEXITY)), F.col("method"))
    eligible = ~F.col("pathological") & (F.col("mismatches") == 0)
    x = compared.withColumn("eligible", eligible).withColumn("order", order)
    best = x.filter("eligible").groupBy("cls").agg(F.min("log_loss").alias("ll"), F.min("brier").alias("br"), F.min_by("method", F.struct("log_loss", "order")).alias("least"))
    near = x.filter("eligible").join(best, "cls").filter((F.col("log_loss") <= F.col("ll") * (1 + tolerance)) & (F.col("brier") <= F.col("br") * (1 + tolerance)))
    own = best.join(near.groupBy("cls").agg(F.min_by("method", "order").alias("simple")), "cls", "left").select("cls", F.coalesce("simple", "least").alias("own"), "ll", "br")
    votes = own.groupBy(F.col("own").alias("method")).agg(F.count(F.lit(1)).alias("votes")).withColumn("order", order)
    top = votes.agg(F.max_by(F.struct("method", "votes"), F.struct("votes", -F.col("order"))).alias("v")).select("v.*")
    loss = F.greatest(F.col("log_loss") / F.col("ll"), F.col("brier") / F.col("br")) - 1
    uniform = x.join(F.broadcast(top), "method").join(own, "cls", "left").agg(F.first("method").alias("uniform"), F.first("votes").alias("votes"), F.count(F.lit(1)).alias("n"), F.bool_and("eligible").alias("all"), F.max(loss).alias("worst"))
    uniform = uniform.select(F.when((F.col("votes") >= share * F.col("n")) & F.col("all") & (F.col("worst") <= most_loss), F.col("uniform")).alias("uniform"))
    return x.join(own.select("cls", "own"), "cls", "left").join(F.broadcast(uniform)).withColumn("chosen", F.coalesce("uniform", "own")).drop("order", "uniform")  # one row
