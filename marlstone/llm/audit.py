"""How text filters interact: what each filter removes at each step of every order, as a product of incidence matrices.

Which filters a document fails is a mask of five bits, so a part of the corpus is three histograms of 32 masks: all
documents, those labelled good, those labelled toxic. Stacked as rows they are multiplied by integer matrices of 32 masks by
600 (order, step) pairs, which say whether a document of a mask is kept after the step, removed at it, fails a filter that
came too late, or fails this filter alone. Documents are read once, whatever the number of orders.

Identical texts are told by SHA-256. A row is reduced to text digest, doc_id, part and mask where it is read, and equal rows
to one with a count, so a frequent text, part or doc_id is summed up before it is dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sliced, table

#: Letters of the filters; filter i is bit i of a mask. A: short, B: few different words, C: many capitals, D: symbols, E: repeated text.
FILTERS = "ABCDE"
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
ORDERS = list(permutations(range(len(FILTERS))))
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, SYMBOLS, FOLLOWING = bytes(range(0x41, 0x5B)), b"#$%&*|", bytes(range(0x80, 0xC0))
REPEATED = 1 << FILTERS.index("E")
RESULT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(text: bytes) -> int:
    """Filters A to D that a text (UTF-8) fails. Words are maximal runs without ASCII white space."""
    words = text.split()  # of bytes: exactly the six ASCII white-space characters
    n = len(words)
    points = len(text.translate(None, FOLLOWING))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << i for i, f in enumerate(fails) if f)


def matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique and shapley: masks by (order, step), order-major, as 64-bit integers."""
    mask = np.arange(MASKS)[:, None]
    at = np.array([[1 << f for f in order] for order in ORDERS])  # the filter of each step
    before = (np.cumsum(at, axis=1) - at).reshape(1, -1)
    now = at.reshape(1, -1)
    fails, earlier = (mask & now) != 0, (mask & before) != 0
    removed = (fails & ~earlier).astype(np.int64)
    same = (now.T == now).astype(np.int64)  # which pairs are of one filter
    return {"kept": (~fails & ~earlier).astype(np.int64), "removed": removed, "redundant": (fails & earlier).astype(np.int64), "unique": (mask == now).astype(np.int64), "shapley": removed @ same}


def failures(docs: DataFrame) -> DataFrame:
    """digest, doc_id, part, mask (filters A to D), n: equal rows of docs (doc_id, text, source) as one. A null text is empty, a
    null source the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            digests, masks = [], []
            for x in b.column("t"):
                text = x.as_py()
                digests.append(hashlib.sha256(text).digest())
                masks.append(mask_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32())], names=["digest", "doc_id", "part", "mask"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return slim.mapInArrow(run, "digest binary, doc_id long, part string, mask int").groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic: counts of documents.

    A document is good or toxic if any label of its doc_id says so. One without a doc_id has no label, fails E for no document
    and makes none fail it; rows that repeat doc_id and text do not fail E for each other.
    """
    rows = materialise(failures(docs), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # Rows without a doc_id meet no label; a number made of the text deals them out.
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn("deal", deal)
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    every = marked.join(known, ["doc_id", "deal"], "left").select("part", (F.col("mask") + F.when(later, REPEATED).otherwise(0)).alias("mask"), "n", *((F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(found: DataFrame) -> DataFrame:
    """600 rows a part (RESULT) from its histograms: one task multiplies the stacked rows of many parts at once."""
    packed = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = matrices()
        names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
        order = pa.array(np.repeat(names, STEPS))
        step = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
        letter = pa.array([FILTERS[f] for o in ORDERS for f in o])
        for b in sliced(batches, 64):
            stack = np.zeros((3, b.num_rows, MASKS), dtype=np.int64)
            for i, rows in enumerate(b.column("rows").to_pylist()):
                for r in rows:
                    stack[:, i, r["mask"]] = r["n"], r["good"], r["toxic"]
            every = {k: stack[0] @ of[k] for k in of}
            lost = (stack[1:].reshape(-1, MASKS) @ of["removed"]).reshape(2, b.num_rows, -1)
            for i in range(b.num_rows):
                part = pa.array([b.column("part")[i].as_py()] * len(letter), pa.string())
                yield pa.RecordBatch.from_arrays([part, order, step, letter, *(pa.array(every[k][i]) for k in ("kept", "removed", "redundant", "unique")), pa.array(lost[0, i]), pa.array(lost[1, i]), pa.array(every["shapley"][i])], names=[f.split()[0] for f in RESULT.split(", ")])

    return packed.mapInArrow(run, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No documents give no rows."""
    return interactions(histograms(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels")))


ORACLE = """
WITH f(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, i::INT AS step, substr(filter_order, i, 1) AS filter, substr(filter_order, 1, i - 1) AS before FROM o, range(1, 6) r(i)),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * up > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS now, length(translate(before, fails, '')) < length(before) AS earlier, fails = filter AS only_this FROM h, s),
g AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT now AND NOT earlier) AS kept, sum(n) FILTER (now AND NOT earlier) AS removed, sum(n) FILTER (now AND earlier) AS redundant, sum(n) FILTER (only_this) AS unique_fails,
  sum(good) FILTER (now AND NOT earlier) AS good_lost, sum(toxic) FILTER (now AND NOT earlier) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g"""
