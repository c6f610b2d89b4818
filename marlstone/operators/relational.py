"""Relational building blocks that DataFrame methods do not name: audits, banding, group statistics, checked joins, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import written
from . import ordered


class CheckFailed(ValueError):
    """A declared property of the data does not hold."""


def target_columns(df: DataFrame, metadata: list[str] | None = None, allowed: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """column, is_target, n_values, n_bad: which columns hold label states only (in one pass over df)."""
    cols = [c for c in df.columns if c not in (metadata or [])]
    value = lambda c: F.col(c).cast("string").try_cast("double")
    bad = lambda c: F.count_if(F.col(c).isNotNull() & F.coalesce(~value(c).isin(*allowed), F.lit(True)))
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n_values"), bad(c).alias("n_bad")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = one.select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("r")).select("r.*")
    return rows.withColumn("is_target", (F.col("n_bad") == 0) & (F.col("n_values") > 0))


def invalid_entries(df: DataFrame, keys: list[str], columns: list[str], allowed: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """keys, column, value: entries that are neither null nor a label state."""
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "column", "value")
    return long.filter(F.col("value").isNotNull() & F.coalesce(~F.col("value").try_cast("double").isin(*allowed), F.lit(True)))


def state_counts(long: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Counts and percentages of positive, negative, uncertain and missing states."""
    n = F.count(F.lit(1))
    x = F.col(raw)
    parts = {"positive": F.count_if(x == 1), "negative": F.count_if(x == 0), "uncertain": F.count_if(x == -1), "missing": F.count_if(x.isNull())}
    g = long.groupBy(*by).agg(n.alias("n"), *[v.alias(k) for k, v in parts.items()])
    return g.select(*by, "n", *parts, *[F.round(100.0 * F.col(k) / F.col("n"), 4).alias(f"{k}_pct") for k in parts], (F.col("n") - sum(F.col(k) for k in parts)).alias("other"))


def band(x: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band whose upper bound (exclusive) exceeds x, else last."""
    out = F.lit(last)
    for upper, name in reversed(bounds):
        out = F.when(x < upper, name).otherwise(out)
    return out


def cut(x: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed intervals; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names):
        out = F.when((x > low) & (x <= high), name).otherwise(out)
    return out


def flag_list(flags: dict[str, Column]) -> tuple[Column, Column]:
    """(number, names joined by ;) of the flags that hold."""
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()]), lambda x: x.isNotNull())
    return F.size(names).cast("long"), F.array_join(names, ";")


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row for each group


def describe(df: DataFrame, by: list[str], x: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    g = ordered.match(g, ordered.quantiles(df, by, x, [0.25, 0.5, 0.75, 0.99]), by, "left")
    return g.select(*by, "n", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3", "p99"))])


def count_summary(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row about a column of counts: mean, quartiles, p95, max and shares of 0, 1, 2-3, 4-5, more."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    x = F.col(n)
    g = counts.agg(F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("long").alias("max"), share(x == 0).alias("share_0"), share(x == 1).alias("share_1"), share(x.between(2, 3)).alias("share_2_3"), share(x.between(4, 5)).alias("share_4_5"), share(x > 5).alias("share_over_5"))
    g = g.join(F.broadcast(ordered.quantiles(counts, [], n, [0.25, 0.5, 0.75, 0.95])), how="left")  # one row
    return g.select("mean", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "p50", "p75", "p95"))], "max", "share_0", "share_1", "share_2_3", "share_4_5", "share_over_5")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that must keep the number of rows: raises if a key repeats on the right."""
    if right.groupBy(*on).count().filter("count > 1").limit(1).count():
        raise CheckFailed(f"{on} repeats on the right side")
    return left.join(right, on, "left")


def require(violations: DataFrame, what: str) -> None:
    """Raises if there is any violation."""
    if violations.limit(1).count():
        raise CheckFailed(what)


def running_total(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over all rows up to and with this one, in order of `by` (distinct). Ranges of rows add up
    on their own; only their totals, a row a range, meet in one task."""
    ranged = written(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__s"))
    before = totals.select("__range", (F.sum("__s").over(Window.orderBy("__range")) - F.col("__s")).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(*by))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).select(*rows.columns, name)  # a row for each range


def duplicate_groups(df: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Rows whose key repeats: key, id, group (dense number by key), size. Groups are counted first, so that only keys that
    repeat are joined back, the rows of a frequent one in several tasks."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1).withColumn("__one", F.lit(1))
    numbered = running_total(groups, key, "__one", "group").drop("__one")
    return ordered.attach(df, numbered, key).select(*key, id_col, F.col("group").cast("long").alias("group"), "size")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("dataset", "severity", "issue").agg(F.count(F.lit(1)).alias("n"))
