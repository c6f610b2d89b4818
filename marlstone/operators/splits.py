"""Leakage-safe splits of groups. Randomness is a hash of seed and group, so a split does not depend on row order or engine."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from . import ordered
from .relational import CheckFailed


def shuffle_key(seed: int | Column, group: Column) -> Column:
    return F.sha2(F.concat((seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), F.lit("|"), group.cast("string")), 256)


def _ratios(ratios: dict[str, float]) -> tuple[list[str], list[float]]:
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    return list(ratios), [float(x) for x in np.round(np.cumsum([float(r) for r in ratios.values()]), 12)]


def _fold(share: Column, names: list[str], bounds: list[float]) -> Column:
    out = F.lit(names[-1])
    for name, upper in reversed(list(zip(names[:-1], bounds[:-1]))):
        out = F.when(share <= upper, name).otherwise(out)
    return out


def _share(rows: DataFrame, by: list[str], weight: str, seed: int | Column) -> DataFrame:
    """rows with `share`: the running share of `weight` in hashed order of group, within each value of `by` (or all rows). The running
    sum goes by the key's first byte first (256 sums), so no task holds all groups of a frequent value."""
    g = rows.withColumn("key", shuffle_key(seed, F.col("group"))).withColumn("head", F.substring("key", 1, 2))
    heads = g.groupBy(*by, "head").agg(F.sum(weight).alias("s"))
    w = Window.partitionBy(*by)
    before = heads.select(*by, "head", (F.sum("s").over(w.orderBy("head")) - F.col("s")).alias("before"), F.sum("s").over(w).alias("total"))  # 256 rows a value
    run = F.sum(weight).over(Window.partitionBy(*by, "head").orderBy("key"))
    return g.withColumn("run", run).join(before, [*by, "head"]).withColumn("share", (F.col("before") + F.col("run")) / F.col("total")).select(*rows.columns, "share")


def random_split(groups: DataFrame, ratios: dict[str, float], seed: int) -> DataFrame:
    """group, size, share, split: groups in hashed order fill the parts by their share of rows."""
    names, bounds = _ratios(ratios)
    return _share(groups.select("group", "size"), [], "size", seed).withColumn("split", _fold(F.col("share"), names, bounds))


def deviations(groups: DataFrame, count: str, ratios: dict[str, float], seeds: int) -> DataFrame:
    """seed, worst: the largest relative deviation of a part's share of `count` in its rows from the overall one, for random splits
    by each seed from 0 on. groups: group, size and the count. All seeds are split in one pass."""
    names, bounds = _ratios(ratios)
    g = groups.select("group", "size", count, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    split = _share(g, ["seed"], "size", F.col("seed")).withColumn("split", _fold(F.col("share"), names, bounds))
    parts = split.groupBy("seed", "split").agg((F.sum(count) / F.sum("size")).alias("x"))
    overall = groups.agg((F.sum(count) / F.sum("size")).alias("overall"))
    return parts.join(F.broadcast(overall)).groupBy("seed").agg(F.max(F.abs(F.col("x") - F.col("overall")) / F.col("overall")).alias("worst"))  # one row


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (with key) with rank (from 0, in order of key and group, within each value of `by`) and n. Rows are counted by the key's
    beginning first (4096 counts a value), so no task ranks all rows of a frequent value."""
    g = rows.withColumn("head", F.substring("key", 1, 3))
    heads = g.groupBy(*by, "head").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    before = heads.select(*by, "head", (F.sum("c").over(w.orderBy("head")) - F.col("c")).alias("before"), F.sum("c").over(w).alias("n"))
    own = F.row_number().over(Window.partitionBy(*by, "head").orderBy("key", "group"))
    return ordered.match(g.withColumn("own", own), before, [*by, "head"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("head", "own", "before")


def stratum_split(groups: DataFrame, ratios: dict[str, float], seed: int) -> DataFrame:
    """group, stratum, split: in each stratum, hashed order cut at the rounded (half to even) cumulative shares."""
    names, bounds = _ratios(ratios)
    r = _ranked(groups.select("group", "stratum").withColumn("key", _key(seed)), ["stratum"])
    out = F.lit(names[-1])
    for name, upper in reversed(list(zip(names[:-1], bounds[:-1]))):
        out = F.when(F.col("rank") + 1 <= F.bround(F.lit(upper) * F.col("n")), name).otherwise(out)
    return r.select("group", "stratum", out.alias("split"))


def _key(seed: int) -> Column:
    """The place of a group in hashed order; a null group comes first."""
    return F.coalesce(shuffle_key(seed, F.col("group")), F.lit(""))


def deal(need: list[tuple[int, int]], weight: int, size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How `count` groups alike go to the parts one after another, each to the part of the largest need (then second need, then the first
    part), which then needs (weight, size) less: (first rank, parts in turn) of each stretch, and how many each part gets.

    The part in front is alone until its need has come down to the next one's; from then on they take turns, until both have come
    down to the third's, and so on: as many stretches as parts, whatever the count.
    """
    if weight <= 0:  # nothing is used up: all to the part in front
        front = max(range(len(need)), key=lambda k: (*need[k], -k))
        return [(0, [front])], [count if k == front else 0 for k in range(len(need))]
    taken = [0] * len(need)
    head = lambda k: (need[k][0] - taken[k] * weight, need[k][1] - taken[k] * size, -k)
    waiting = sorted(range(len(need)), key=head, reverse=True)
    turns, stretches, at = [waiting.pop(0)], [], 0
    while at < count:
        turns.sort(key=head, reverse=True)
        length = count - at
        if waiting:
            n, m, place = head(waiting[0])
            picks = 0
            for k in turns:
                n_k, m_k, place_k = head(k)
                full, rest = divmod(n_k - n, weight)
                picks += max(0, full + (1 if rest else (m_k - full * size, place_k) > (m, place)))
            length = min(length, picks)
        stretches.append((at, list(turns)))
        full, rest = divmod(length, len(turns))
        for i, k in enumerate(turns):
            taken[k] += full + (i < rest)
        at += length
        if waiting:
            turns.append(waiting.pop(0))
    return stretches, taken


def stratified_split(groups: DataFrame, ratios: dict[str, float], seed: int) -> DataFrame:
    """group, split: iterative multi-label stratification. groups: group, size, labels (array of counts, nulls are 0).

    Again and again the label with the fewest rows in groups not yet assigned is taken (ties: the first one), and each group
    with it goes to the part that still needs the label most (ties: that needs rows most, then the first part), which then needs
    what the group has of every label, and its rows, less. Groups without any label go by rows. Within a round the
    groups with most of the label come first, then the larger ones, then hashed order.

    So a round is settled by how many groups there are of each (count of the label, size): only these counts, at most one for
    each pair that occurs, and sums by part come to the driver; which part the i-th group of a kind gets follows from its rank.
    Groups are never gathered, and a round is one pass over them. Ratios are taken as decimal fractions, so needs are whole numbers.
    """
    names, _ = _ratios(ratios)
    shares = [Fraction(str(r)).limit_denominator(10**6) for r in ratios.values()]
    unit = math.lcm(*(x.denominator for x in shares))
    parts = [int(x * unit) for x in shares]
    g = files.written(groups.select("group", F.col("size").cast("long").alias("size"), F.transform("labels", lambda n: F.coalesce(n, F.lit(0)).cast("long")).alias("labels")).withColumn("key", _key(seed)), "groups")
    rows = g.agg(F.sum("size")).first()[0] or 0
    left = {r["i"]: r["n"] for r in g.select(F.posexplode("labels").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row a label
    need = {i: [p * n for p in parts] for i, n in left.items()}
    need_rows = [p * rows for p in parts]
    open_, done = g, []

    def settle(members: DataFrame, weight: Column, label: int | None) -> DataFrame:
        kinds = members.groupBy(weight.alias("w"), "size").count().collect()  # a row for each pair of count and size
        plan = []
        for k in sorted(kinds, key=lambda k: (-k["w"], -k["size"])):
            first = need_rows if label is None else need[label]
            stretches, taken = deal(list(zip(first, need_rows)), unit * k["w"], unit * k["size"], k["count"])
            plan.append((k["w"], k["size"], [{"start": a, "parts": p} for a, p in stretches]))
            for i, c in enumerate(taken):
                need_rows[i] -= unit * k["size"] * c
                if label is not None:
                    need[label][i] -= unit * k["w"] * c
        table = g.sparkSession.createDataFrame(plan, "w long, size long, stretches array<struct<start:long,parts:array<int>>>")
        ranked = _ranked(members.withColumn("w", weight), ["w", "size"]).join(table, ["w", "size"])
        at = F.element_at(F.filter("stretches", lambda s: s["start"] <= F.col("rank")), -1)
        part = F.get(at["parts"], ((F.col("rank") - at["start"]) % F.size(at["parts"])).cast("int"))
        return files.written(ranked.select("group", "labels", part.alias("part")), "assigned")

    while active := [i for i, n in left.items() if n > 0]:
        label = min(active, key=lambda i: (left[i], i))
        has = F.coalesce(F.get("labels", label), F.lit(0)) > 0
        step = settle(open_.filter(has), F.get("labels", label), label)
        for r in step.select("part", F.posexplode("labels").alias("i", "n")).groupBy("part", "i").agg(F.sum("n").alias("n")).collect():  # a row a part and label
            left[r["i"]] -= r["n"]
            if r["i"] != label:
                need[r["i"]][r["part"]] -= unit * r["n"]
        done.append(step)
        open_ = open_.filter(~has)
    done.append(settle(open_, F.col("size"), None))
    every = reduce(DataFrame.unionByName, (d.select("group", "part") for d in done))
    return every.select("group", F.get(F.array(*map(F.lit, names)), F.col("part")).alias("split"))


def stratified_folds(rows: DataFrame, group: str, labels: dict[str, Column], k: int, seed: int) -> DataFrame:
    """group, fold (0 to k - 1): folds of whole groups, stratified by how many valid positive rows of each label a group has. labels:
    a condition each (null: not valid). An error where a group is null."""
    per = rows.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("size"), F.array(*(F.count_if(c) for c in labels.values())).alias("labels"))
    split = stratified_split(per, {str(i): Fraction(1, k) for i in range(k)}, seed)
    out = files.written(split.select("group", F.col("split").cast("int").alias("fold")), "folds")
    check_leakage(out, "group", "fold")
    return out


def folds(group: Column, k: int, seed: int = 0) -> Column:
    """A fold from 0 to k - 1 for each group."""
    return (F.conv(F.substring(shuffle_key(seed, group), 1, 8), 16, 10).cast("long") % k).cast("int")


def check_leakage(rows: DataFrame, group: str, split: str) -> None:
    bad = rows.groupBy(group).agg(F.count_distinct(split).alias("n")).filter((F.col("n") > 1) | F.col(group).isNull())
    if bad.limit(1).count():
        raise CheckFailed(f"{group} is null or in more than one {split}")
