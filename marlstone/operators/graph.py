"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import discard, written
from . import ordered


def components(edges: DataFrame) -> DataFrame:
    """node, label: smallest node of its component, for every node of an edge (a, b); nulls are no nodes.

    Two steps by turns until nothing changes: every node's larger neighbours are joined to its smallest neighbour, then every
    node and its smaller neighbours are. Both keep the components and make no edge more, so the table never grows; the rounds grow with
    the logarithm of the longest path. The edges of a hub meet its smallest neighbour in several tasks. Each round's table
    is removed once the next one is written.
    """
    ends = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = written(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    stars = written(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered.attach(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = ordered.attach(large, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(large)
        discard(stars)
        stars, after = now, _mark(now)
        if after == before:
            break
        before = after
    return nodes.join(stars.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    """Number and sums of hashes of the edges: equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def star_edges(members: DataFrame) -> DataFrame:
    """a, b: each member of a group with the group's smallest (columns group, id): a row a member, never all pairs."""
    least = members.groupBy("group").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("group", "a")
    return ordered.attach(members, least, ["group"]).filter("id <> a").select("a", F.col("id").alias("b"))
