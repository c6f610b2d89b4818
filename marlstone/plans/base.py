"""What the registered queries share: tables, rounding, and how the driver's tables stand for the engine's inputs.

Conventions (the driver's tables have no labelled reports, so these stand in for them):
- sections of a report: the first line of a document, and the rest;
- four-state labels: documents joined with labels; 1, 0, null (not labelled), -1 (uncertain: low quality and toxic);
- multi-label matrix: orders by the types of their parts;
- score matrix: similarity of each vector to each class's mean vector, one class against the rest;
- groups: customers > orders > line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r ]+"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str, n: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, first, rest."""
    first = F.substring_index("text", "\n", 1)
    return t(spark, sf, "documents").select("doc_id", first.alias("first"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("rest"))


SECTIONS = "sec AS (SELECT doc_id, split_part(text, chr(10), 1) AS first, substr(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM documents)"


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: doc_id, source, lang, label, raw (1, 0, -1, null)."""
    d = t(spark, sf, "documents").select("doc_id", "source", "lang").join(t(spark, sf, "labels"), "doc_id", "left")
    unsure = (F.col("quality") == 0) & (F.col("toxic") == 1)
    raw = lambda c: F.when(unsure, -1).otherwise(F.col(c)).cast("double")
    return d.select("doc_id", "source", "lang", F.explode(F.array(F.struct(F.lit("quality").alias("label"), raw("quality").alias("raw")), F.struct(F.lit("toxic").alias("label"), raw("toxic").alias("raw")))).alias("s")).select("doc_id", "source", "lang", "s.label", "s.raw")


STATES = """st AS (SELECT d.doc_id, d.source, d.lang, k.label,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN -1 WHEN k.label = 'quality' THEN l.quality ELSE l.toxic END::DOUBLE AS raw
  FROM documents d LEFT JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic')) k(label))"""


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, label): orders and their part types."""
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("label")), "l_partkey").select(F.col("l_orderkey").alias("id"), "label").distinct()


MATRIX = "m AS (SELECT DISTINCT l_orderkey AS id, p_type AS label FROM lineitem JOIN part ON l_partkey = p_partkey)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, cls, y (0/1), p: one-against-rest scores of every vector, rounded to 6 places."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy(F.col("label").alias("cls")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    centres = centres.withColumn("norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)))
    pairs = e.join(F.broadcast(centres))  # a row for each class: the number of classes bounds it
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return pairs.select("vec_id", "cls", (F.col("label") == F.col("cls")).cast("int").alias("y"), F.round((1 + dot / F.col("norm")) / 2, 6).alias("p"))


SCORES = """em AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label AS cls, i, avg(x) AS m FROM em GROUP BY 1, 2),
nrm AS (SELECT cls, sqrt(sum(m * m)) AS nn FROM cen GROUP BY 1),
sc AS (SELECT e.vec_id, c.cls, (CASE WHEN e.label = c.cls THEN 1 ELSE 0 END) AS y, round((1 + sum(e.x * c.m) / max(n.nn)) / 2, 6) AS p
  FROM em e JOIN cen c ON c.i = e.i JOIN nrm n ON n.cls = c.cls GROUP BY e.vec_id, e.label, c.cls)"""
