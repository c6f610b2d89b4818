"""Running sums, numbering and as-of joins within groups of any size.

A group is cut into ranges of about SHARE rows by quantiles of its order; each range is summed by itself, and the ranges'
totals, a short list a group, are summed before them. So a group with most of the rows takes as many tasks as it has ranges.
Groups that are all small need no ranges. Inputs are read several times: pass tables that are written.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files

SHARE = 1 << 17


def match(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, null equal to null, once each column of `by`. Without `by`, right is one row."""
    if not by:
        return left.join(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return left.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]), how).drop(*(f"__by_{c}" for c in by))


def largest(rows: DataFrame, by: list[str]) -> int:
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def ranged(rows: DataFrame, by: list[str], order: str, share: int = SHARE) -> tuple[DataFrame, bool]:
    """rows with __part, the number of the range of `order` (numeric; nulls come first) within the group, and whether any group has more
    than one. The quantiles are written, so that every reader cuts alike."""
    most = largest(rows, by)
    if most <= share:
        return rows.withColumn("__part", F.lit(0)), False
    parts = 1 + most // share
    cuts = rows.groupBy(*by).agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts"))
    part = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))
    return match(rows, files.written(cuts, "cuts"), by).withColumn("__part", part).drop("__cuts"), True


def running(rows: DataFrame, by: list[str], order: str, values: list[str], share: int = SHARE) -> DataFrame:
    """rows with, for each of `values`, <value>_upto (its sum over the group's rows up to this one; `order` is unique in a group)
    and <value>_all (over the group)."""
    cut, many = ranged(rows, by, order, share)
    upto = Window.partitionBy(*by, "__part").orderBy(order)
    out = cut.select("*", *(F.sum(v).over(upto).alias(f"{v}_upto") for v in values))
    if not many:
        whole = Window.partitionBy(*by, "__part")
        return out.select("*", *(F.sum(v).over(whole).alias(f"{v}_all") for v in values)).drop("__part")
    sums = cut.groupBy(*by, "__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))  # a row for each range
    across, all_ = Window.partitionBy(*by).orderBy("__part"), Window.partitionBy(*by)
    before = sums.select(*by, "__part", *(x for v in values for x in ((F.sum(f"__{v}").over(across) - F.col(f"__{v}")).alias(f"__{v}"), F.sum(f"__{v}").over(all_).alias(f"{v}_all"))))
    joined = match(out, before, [*by, "__part"])
    return joined.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.col(f"__{v}") for v in values}).drop("__part", *(f"__{v}" for v in values))


def numbered(rows: DataFrame, by: list[str], order: str, share: int = SHARE) -> DataFrame:
    """rows with n_th (from 1 in each group) and n_all."""
    return running(rows.withColumn("__n", F.lit(1).cast("long")), by, order, ["__n"], share).withColumnsRenamed({"__n_upto": "n_th", "__n_all": "n_all"}).drop("__n")


def as_of(values: DataFrame, knots: DataFrame, by: list[str], value: str, knot: str, share: int = SHARE) -> DataFrame:
    """values with `at`: the row of knots (as a struct, without `by`) of the largest `knot` not above `value`, null before the first one.

    Knots are distinct in a group. Values and knots are sorted together, range by range; a range begins with the last knot of those
    before it.
    """
    rest = [c for c in knots.columns if c not in by]
    found = F.struct(*rest)
    order = "__x"
    left = values.select(*(F.col(c) for c in values.columns), F.col(value).cast("double").alias(order), F.lit(1).alias("__kind"))
    right = knots.select(*by, F.col(knot).cast("double").alias(order), F.lit(0).alias("__kind"), found.alias("at"))
    cut, many = ranged(left.unionByName(right, allowMissingColumns=True), by, order, share)
    w = Window.partitionBy(*by, "__part").orderBy(order, "__kind")
    out = cut.withColumn("at", F.last("at", ignorenulls=True).over(w))
    if many:
        ends = cut.groupBy(*by, "__part").agg(F.max_by("at", F.when(F.col("__kind") == 0, F.col(order))).alias("__end"))  # a row for each range
        before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        out = match(out, ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before)), [*by, "__part"]).withColumn("at", F.coalesce("at", "__end"))
    return out.filter("__kind = 1").select(*values.columns, "at")


def attach(rows: DataFrame, small: DataFrame, by: list[str], salts: int = 16) -> DataFrame:
    """rows joined with small, which has one row for each value of `by`: frequent values meet theirs in several tasks."""
    dealt = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return match(dealt, small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*by, "__salt"]).drop("__salt")


def interpolated(rows: DataFrame, knots: DataFrame, by: list[str], value: str, share: int = SHARE) -> DataFrame:
    """rows with q: linear between the group's knots (x, y; x distinct), flat outside. Rows of groups without knots are left out.

    Each distinct value is looked up once.
    """
    stored = files.written(numbered(files.written(knots.select(*by, "x", "y"), "knots"), by, "x", share).drop("n_all"), "knots")
    following = stored.select(*by, (F.col("n_th") - 1).alias("n_th"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pieces = match(stored, following, [*by, "n_th"], "left").drop("n_th")
    asked = files.written(rows.select(*by, value).distinct(), "values")
    low = stored.filter("n_th = 1").select(*by, F.col("y").alias("__low"))  # a row for each group
    v, at = F.col(value), F.col("at")
    line = at["y"] + F.coalesce(F.try_divide(v - at["x"], at["x2"] - at["x"]) * (at["y2"] - at["y"]), F.lit(0.0))
    looked = match(as_of(asked, files.written(pieces, "pieces"), by, value, "x", share), low, by)
    return attach(rows, looked.select(*by, value, F.when(at.isNull(), F.col("__low")).otherwise(line).alias("q")), [*by, value])


def largest_by(rows: DataFrame, by: list[str], key: Column, then: Column) -> DataFrame:
    """by, key, n_tied, then: the largest key of each group, how many rows have it, and the largest `then` among them."""
    g = rows.groupBy(*by, key.alias("key")).agg(F.count(F.lit(1)).alias("n_tied"), F.max(then).alias("then"))
    return g.groupBy(*by).agg(F.max(F.struct("key", "n_tied", "then")).alias("k")).select(*by, "k.key", "k.n_tied", "k.then")


def quantiles(rows: DataFrame, by: list[str], value: str, qs: list[float], share: int = SHARE) -> DataFrame:
    """by, q: exact quantiles (array, in the order of qs; linear between neighbours) of each group's values; nulls are left out.
    Groups without a value have no row; without `by` there is one row, null if there is no value.

    Values are counted, the counts summed range by range, and only the values that stand at an asked place are kept: no
    task holds the distinct values of a group.
    """
    counted = files.written(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__k")), "counts")
    summed = running(counted, by, "__v", ["__k"], share)

    def weight(q: Column) -> Column:
        """How much of the quantile this value is: 1, or the part of each of the two neighbours."""
        at = (F.col("__k_all") - 1) * q
        low = F.floor(at)
        holds = lambda i: ((i >= F.col("__k_upto") - F.col("__k")) & (i < F.col("__k_upto"))).cast("double")
        return holds(low) * (1 - (at - low)) + holds(low + 1) * (at - low)

    found = summed.select(*by, "__v", F.posexplode(F.transform(F.array(*map(F.lit, map(float, qs))), weight)).alias("__i", "__w")).filter("__w > 0")
    each = found.groupBy(*by, "__i").agg(F.sum(F.col("__v") * F.col("__w")).alias("__x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"])  # len(qs) a group
    return each.groupBy(*by).agg(F.when(F.size(listed) > 0, listed).alias("q"))
