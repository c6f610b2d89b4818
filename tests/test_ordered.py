"""Range by range work equals plain work: running sums, as-of joins, thresholds, bins, isotonic fits, iterative stratification."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import calibrate, classify, ordered, splits
from marlstone.operators.relational import CheckFailed


@pytest.fixture(scope="module")
def scores(spark):
    """A class with nearly all rows, one of two, one of equal scores, and one without a name; ids are distinct."""
    r = random.Random(5)
    rows = [(1, i, int(r.random() < 0.4), round(r.random() ** 3, 3)) for i in range(3000)] + [(2, 3000, 1, 0.5), (2, 3001, 0, 0.25)]
    rows += [(3, 4000 + i, int(i % 3 == 0), 0.125) for i in range(500)] + [(None, 5000 + i, i % 2, i / 90) for i in range(90)]
    return spark.createDataFrame(rows, "cls int, id long, y int, p double").cache()


def bag(df):
    return sorted(map(str, df.collect()))


def test_running(spark, scores):
    rows = scores.groupBy("cls", "p").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("k"))
    got = ordered.running(rows, ["cls"], "p", ["y", "k"], share=40)
    want, sums = {}, {}
    data = sorted(rows.collect(), key=lambda r: r["p"])
    for r in data:
        y, k = sums.get(r["cls"], (0, 0))
        sums[r["cls"]] = want[r["cls"], r["p"]] = (y + r["y"], k + r["k"])
    assert {(r["cls"], r["p"]): (r["y_upto"], r["k_upto"]) for r in got.collect()} == want
    assert all((r["y_all"], r["k_all"]) == sums[r["cls"]] for r in got.collect())
    parts = ordered.ranged(rows, ["cls"], "p", 40)[0].groupBy("cls", "__part").count().collect()
    assert max(r["count"] for r in parts) <= 2 * 40 and len({r["__part"] for r in parts if r["cls"] == 1}) > 10
    assert ordered.running(rows.limit(0), ["cls"], "p", ["y"], 40).count() == 0


def test_as_of_and_interpolation(spark, scores):
    knots = spark.createDataFrame([(c, float(x), float(x * x % 7)) for c in (1, None) for x in np.linspace(0.05, 0.8, 200)] + [(2, 0.3, 9.0)], "cls int, x double, y double")
    for share in (30, 1 << 17):
        got = ordered.as_of(scores, knots, ["cls"], "p", "x", share)
        assert got.count() == scores.count()
        at = {c: sorted(r["x"] for r in knots.collect() if r["cls"] == c) for c in (1, 2, None)}
        for r in got.collect():
            before = [x for x in at.get(r["cls"], []) if x <= r["p"]]
            assert (r["at"]["x"] if r["at"] else None) == (before[-1] if before else None)
        q = ordered.interpolated(scores, knots, ["cls"], "p", share).collect()
        by = {c: tuple(zip(*sorted((r["x"], r["y"]) for r in knots.collect() if r["cls"] == c))) for c in at}
        assert len(q) == scores.filter("cls is null or cls <> 3").count()
        assert all(abs(r["q"] - np.interp(r["p"], *by[r["cls"]])) < 1e-9 for r in q)


def test_thresholds_and_bins_by_ranges(scores):
    one, many = classify.candidates(scores, ["cls"]), classify.candidates(scores, ["cls"], share=40)
    assert bag(one) == bag(many)
    assert bag(classify.youden(many, ["cls"])) == bag(classify.youden(one, ["cls"]))
    named = scores.filter("cls is not null")
    gate = lambda share: classify.gate(named.withColumn("positive", F.col("p") > 0.1), ["cls"], [0.0, 0.3, 0.6, 0.9], share=share)
    assert bag(gate(40)) == bag(gate(1 << 17))
    got = classify.reliability(scores, ["cls"], "id", 10, share=40)
    data = sorted(scores.filter("cls = 1 or cls = 3").collect(), key=lambda r: (r["cls"], r["p"], r["id"]))
    for c in (1, 3):
        rows = [r for r in data if r["cls"] == c]
        want = [(len(b), sum(r["y"] for r in b)) for b in np.array_split(np.array(rows, dtype=object), 10) for b in [[dict(zip(("cls", "id", "y", "p"), r)) for r in b]]]
        assert [(r["n"], r["n_positive"]) for r in sorted(got.filter(F.col("cls") == c).collect(), key=lambda r: r["bin"])] == want


def test_isotonic_by_chunks(spark, scores):
    # Rising, falling, and a low last block that takes in many before it.
    rows = [(1, i / 4000, (i * 7919) % 4000 < i) for i in range(4000)] + [(2, i / 900, i < 450) for i in range(900)] + [(3, i / 900, True) for i in range(899)] + [(3, 1.0, False)] * 3000
    points = calibrate.compact(spark.createDataFrame([(c, int(y), float(np.clip(p, 1e-6, 1 - 1e-6))) for c, p, y in rows], "cls int, y int, p double")).cache()
    assert bag(calibrate.fit_isotonic(points, share=64).withColumn("y", F.round("y", 12))) == bag(calibrate.fit_isotonic(points).withColumn("y", F.round("y", 12)))


def sequential(groups: list[tuple], shares: list[Fraction], order: dict) -> dict:
    """One group after another, with fractions."""
    need = [[s * sum(g[2][i] for g in groups) for i in range(len(groups[0][2]))] for s in shares]
    rows, part = [s * sum(g[1] for g in groups) for s in shares], {}
    while True:
        left = [sum(g[2][i] for g in groups if g[0] not in part) for i in range(len(groups[0][2]))]
        label = min((i for i, n in enumerate(left) if n > 0), key=lambda i: left[i], default=None)
        todo = [g for g in groups if g[0] not in part and (label is None or g[2][label] > 0)]
        for g in sorted(todo, key=lambda g: (-(g[1] if label is None else g[2][label]), -g[1], order[g[0]])):
            k = max(range(len(shares)), key=lambda k: (rows[k] if label is None else need[k][label], rows[k], -k))
            part[g[0]] = k
            rows[k] -= g[1]
            need[k] = [n - x for n, x in zip(need[k], g[2])]
        if label is None:
            return part


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_iterative_stratification(spark, seed):
    r = random.Random(seed)
    groups = [(i, r.choice([1, 1, 2, 3, 40]), [r.choice([0, 0, 0, 1, 1, 5]) * (r.random() < p) for p in (0.9, 0.3, 0.05, 0.0)]) for i in range(240)]
    df = spark.createDataFrame(groups, "group long, size long, labels array<long>")
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    order = {x["group"]: x["k"] for x in df.select("group", splits.shuffle_key(seed, F.col("group")).alias("k")).collect()}
    want = sequential(groups, [Fraction(str(x)) for x in ratios.values()], order)
    got = {x["group"]: x["split"] for x in splits.stratified_split(df, ratios, seed).collect()}
    assert got == {g: list(ratios)[k] for g, k in want.items()}
    for i in range(3):  # a part is off by a group at most
        total, most = sum(g[2][i] for g in groups), max(g[2][i] for g in groups)
        for name, share in ratios.items():
            assert abs(sum(g[2][i] for g in groups if got[g[0]] == name) - share * total) <= 2 * most
    assert splits.stratified_split(df.limit(0), ratios, seed).count() == 0


def test_dealing_equals_turn_by_turn():
    r = random.Random(9)
    for _ in range(300):
        need = [(r.randint(-20, 60), r.randint(-20, 60)) for _ in range(r.randint(1, 5))]
        weight, size, count = r.randint(1, 9), r.randint(1, 9), r.randint(1, 60)
        stretches, taken = splits.deal(need, weight, size, count)
        now, want = list(need), []
        for _ in range(count):
            k = max(range(len(now)), key=lambda k: (*now[k], -k))
            want.append(k)
            now[k] = (now[k][0] - weight, now[k][1] - size)
        got = []
        for i in range(count):
            start, parts = [s for s in stretches if s[0] <= i][-1]
            got.append(parts[(i - start) % len(parts)])
        assert got == want and taken == [want.count(k) for k in range(len(need))]


def test_folds(spark):
    r = np.random.default_rng(6)
    rows = [(f"p{i}", *(bool(x) for x in r.random(4) < [0.03, 0.1, 0.2, 0.4]), bool(r.random() > 0.05)) for i in range(300) for _ in range(r.integers(1, 5))]
    df = spark.createDataFrame(rows, "patient string, a boolean, b boolean, c boolean, d boolean, valid boolean").cache()
    labels = {x: F.when(F.col("valid"), F.col(x)) for x in "abcd"}
    one, two = (splits.stratified_folds(df, "patient", labels, 5, seed) for seed in (11, 12))
    assert one.count() == 300 and one.select("patient" if "patient" in one.columns else "group").distinct().count() == 300 and bag(one) != bag(two)
    per = df.join(one.withColumnRenamed("group", "patient"), "patient").groupBy("fold").agg(*(F.count_if(c).alias(x) for x, c in labels.items())).collect()
    for x in labels:
        counts = [p[x] for p in per]
        assert len(counts) == 5 and max(counts) - min(counts) <= 8 and min(counts) > 0
    with pytest.raises(CheckFailed):
        splits.stratified_folds(df.unionByName(df.limit(1).withColumn("patient", F.lit(None).cast("string"))), "patient", labels, 5, 1)
