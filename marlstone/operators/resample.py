"""Bootstrap comparisons, staged selection and exact tests.

A unit's multiplicity in draw b is Poisson(1), from a hash of seed, unit and draw: it is known wherever the unit is, all systems,
classes and tasks share it, and nothing is gathered, however many units there are. A group bootstrap hashes the group's name.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

SEED = 42


def poisson_steps(most: int = 8) -> list[tuple[int, float]]:
    """(k, P(X <= k)) of Poisson(1) for k < most; what is beyond counts as most."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(most):
        total += term
        out.append((k, total))
        term /= k + 1
    return out


def weights(unit: Column, b: Column, seed: int = SEED) -> Column:
    """The multiplicity of a unit (or group) in draw b."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), unit.cast("string"), b.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    steps = poisson_steps()
    out = F.lit(len(steps))
    for k, upper in reversed(steps):
        out = F.when(u < upper, k).otherwise(out)
    return out


def drawn(units: DataFrame, unit: str, n_boot: int, seed: int = SEED) -> DataFrame:
    """units with b and w, a row for each draw that holds the unit: a hash a unit and draw."""
    steps = poisson_steps()
    of = lambda b: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string"), b.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    every = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: F.struct(b.alias("b"), of(b).alias("u")))
    some = units.select("*", F.explode(F.filter(every, lambda x: x["u"] >= steps[0][1])).alias("x"))
    return some.select(*units.columns, F.col("x.b").alias("b"), sum((F.col("x.u") >= upper).cast("int") for _, upper in steps).alias("w"))


def draws(units: DataFrame, n_boot: int, seed: int = SEED) -> DataFrame:
    """b, unit, w for w > 0. units: unit."""
    every = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    return every.select("b", "unit", weights(F.col("unit"), F.col("b"), seed).alias("w")).filter("w > 0")


def mean_ci(values: DataFrame, n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """name, mean, low, high: percentile intervals of means over units; nulls are left out of each mean. values: name, unit, x.
    All names share the draws, so differences of columns are paired. A draw without any unit of a name is left out."""
    by_unit = values.filter("x is not null").groupBy("unit").agg(F.collect_list(F.struct("name", "x")).alias("xs"))  # a value a system
    drawn = by_unit.select("unit", "xs", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select("b", "xs", weights(F.col("unit"), F.col("b"), seed).alias("w")).filter("w > 0")
    boots = drawn.select("b", "w", F.explode("xs").alias("v")).groupBy("v.name", "b").agg((F.sum(F.col("w") * F.col("v.x")) / F.sum("w")).alias("mean"))
    ci = boots.groupBy("name").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return values.groupBy("name").agg(F.avg("x").alias("mean")).join(ci, "name", "left").select("name", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def differences(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """name ('a - b'), unit, x: paired differences, null where either is."""
    names = sorted({n for p in pairs for n in p})
    wide = values.filter(F.col("name").isin(names)).groupBy("unit").agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(f"s{i}") for i, n in enumerate(names)])
    of = {n: F.col(f"s{i}") for i, n in enumerate(names)}
    return wide.select("unit", F.explode(F.array(*[F.struct(F.lit(f"{a} - {b}").alias("name"), (of[a] - of[b]).alias("x")) for a, b in pairs])).alias("d")).select("d.name", "unit", "d.x")


def paired(values: DataFrame, a: str, b: str, n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """name ('a - b'), mean, low, high of the paired difference."""
    return mean_ci(differences(values, [(a, b)]), n_boot, seed)


def all_differences(values: DataFrame, n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """Paired differences of all systems, over the units that every system has."""
    names = [r["name"] for r in values.select("name").distinct().orderBy("name").collect()]  # a row a system
    common = values.filter("x is not null").groupBy("unit").agg(F.count_distinct("name").alias("k")).filter(F.col("k") == len(names)).select("unit")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return mean_ci(differences(values.join(common, "unit", "left_semi"), pairs), n_boot, seed)


@pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact test of the tables [[a, b], [c, d]]."""

    def one(a: int, b: int, c: int, d: int) -> float:
        r1, r2, c1 = a + b, c + d, a + c
        lf = math.lgamma
        base = lf(r1 + 1) + lf(r2 + 1) + lf(c1 + 1) + lf(b + d + 1) - lf(r1 + r2 + 1)
        p = lambda x: math.exp(base - lf(x + 1) - lf(r1 - x + 1) - lf(c1 - x + 1) - lf(r2 - c1 + x + 1))
        seen = p(a)
        return min(1.0, sum(q for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (q := p(x)) <= seen * (1 + 1e-7)))

    return pd.Series([one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])


def challenge(values: DataFrame, incumbent: str, stages: list[tuple[str, list[str]]], n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """step, stage, challenger, mean, low, wins, incumbent: staged selection. In each stage the challengers are compared one after
    another with the incumbent; one replaces it if the interval of its paired gain lies above zero. All comparisons that can come
    about are made in one pass over the values."""
    order = [incumbent, *(c for _, cs in stages for c in cs)]
    pairs = [(b, a) for i, a in enumerate(order) for b in order[i + 1 :] if a != b]
    ci = {r["name"]: r for r in mean_ci(differences(values, pairs), n_boot, seed).collect()}  # a row a pair of systems
    rows = []
    for stage, challengers in stages:
        for name in challengers:
            found = ci.get(f"{name} - {incumbent}")
            wins = found is not None and found["low"] is not None and found["low"] > 0
            incumbent = name if wins else incumbent
            rows.append((len(rows) + 1, stage, name, None if found is None else found["mean"], None if found is None else found["low"], wins, incumbent))
    return values.sparkSession.createDataFrame(rows, "step int, stage string, challenger string, mean double, low double, wins boolean, incumbent string")


#: What an advance to a larger K has to meet.
LEAST_GAIN, MOST_FALL, MOST_DUPLICATES, MOST_WORDS = 0.05, 0.03, 0.50, 1000
CONDITIONS = ["gain_interval_above_zero", "gain_large_enough", "similarity_kept", "duplicates_bounded", "templates_grow", "context_bounded"]


def advance(values: DataFrame, ks: list[int], n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """from_k, to_k, the six conditions, advance, selected: from the smallest K on, the smallest larger K that meets all conditions
    is next, until none does. values: unit, k, coverage, similarity, duplicates, templates, words (nulls are left out of means)."""
    ks = sorted(ks)
    gains = differences(values.select(F.col("k").cast("string").alias("name"), "unit", F.col("coverage").alias("x")), [(str(b), str(a)) for i, a in enumerate(ks) for b in ks[i + 1 :]])
    ci = {r["name"]: r for r in mean_ci(gains, n_boot, seed).collect()}  # a row a pair of Ks
    mean = {r["k"]: r for r in values.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("similarity", "duplicates", "templates", "words")]).collect()}  # a row a K
    rows, at = [], ks[0]
    while True:
        passed = []
        for k in (k for k in ks if k > at):
            g, a, b = ci[f"{k} - {at}"], mean[at], mean[k]
            holds = [g["low"] > 0, g["mean"] >= LEAST_GAIN, a["similarity"] - b["similarity"] <= MOST_FALL, b["duplicates"] <= MOST_DUPLICATES, b["templates"] - a["templates"] > 0, b["words"] <= MOST_WORDS]
            rows.append((at, k, *map(bool, holds), all(holds)))
            passed += [k] * all(holds)
        if not passed:
            break
        at = min(passed)
    out = values.sparkSession.createDataFrame(rows, "from_k int, to_k int, " + ", ".join(f"{c} boolean" for c in CONDITIONS) + ", advance boolean")
    return out.withColumn("selected", F.lit(at))
