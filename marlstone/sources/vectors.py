"""A vector index in a folder: vectors in parts by a hash of their ids, and a manifest that says what every part must hold.

Each call of `append` adds a batch: folders batch=.../part=... of vectors, then a row a part in the manifest. A batch whose manifest
rows are not there (its writer was lost) is not part of the index. Reading verifies first.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
#: How far the norm of a unit vector may be from 1.
UNIT = 1e-3
_MANIFEST = "batch string, part int, parts int, rows long, dim int, low double, high double, checksum long, unit boolean"


class IndexDamaged(ValueError):
    """The folder does not hold what its manifest says."""


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _part(parts: int | Column) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _sums(rows: DataFrame) -> DataFrame:
    """What a manifest states of each part: rows, dimension (null if there are several), least and largest norm, and a checksum."""
    n = F.size("v")
    return rows.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("rows"), F.when(F.min(n) == F.max(n), F.min(n)).alias("dim"), F.min(_norm("v")).alias("low"), F.max(_norm("v")).alias("high"), F.bit_xor(F.xxhash64("id", "v")).alias("checksum"))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(vectors: DataFrame, path: str, parts: int = PARTS, unit: bool = False) -> None:
    """Adds vectors (id long, v array) to the index at path, which is made if there is none; all rows or, if a check fails, none.

    An error: a null id, vector or component, a value that is not finite, an id that repeats or is in the index, a dimension other than the
    index's, or, with unit, a norm that is not 1. An index keeps its number of parts.
    """
    spark = vectors.sparkSession
    old = _manifest(spark, path) if _exists(spark, f"{path}/manifest") else None
    if old is not None:
        parts = old.select("parts").first()[0]
    batch = uuid.uuid4().hex[:12]
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("float")).alias("v")).withColumn("batch", F.lit(batch)).withColumn("part", _part(parts))
    bad = F.col("id").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if unit:
        bad = bad | (F.abs(_norm("v") - 1) > UNIT)
    if rows.filter(F.coalesce(bad, F.lit(True))).limit(1).count():
        raise ValueError("a vector without id, with missing or infinite values, or not of norm 1")
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id repeats")
    if old is not None and load(spark, path).join(rows.select("id"), "id", "left_semi").limit(1).count():
        raise ValueError("an id is in the index already")
    sums = _sums(rows).collect()  # a row a part
    dims = {r["dim"] for r in sums} | ({r["dim"] for r in old.select("dim").distinct().collect()} if old is not None else set())
    if len(dims) > 1:
        raise ValueError("vectors of different dimensions")
    if not sums:
        return
    rows.repartition(parts, "part").sortWithinPartitions("part", "id").write.mode("append").partitionBy("batch", "part").parquet(f"{path}/vectors")
    spark.createDataFrame([(r["batch"], r["part"], parts, r["rows"], r["dim"], r["low"], r["high"], r["checksum"], unit) for r in sums], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """batch, part, problem: parts that are missing, unreadable as a whole, or unlike their manifest. One pass over the vectors."""
    stated = _manifest(spark, path)
    found = _sums(_rows(spark, path))
    j = stated.join(found.select("batch", "part", *(F.col(c).alias(f"f_{c}") for c in ("rows", "dim", "low", "high", "checksum"))), ["batch", "part"], "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"f_{c}"))
    problem = F.when(F.col("f_rows").isNull(), "missing").when(~same("rows"), "rows").when(~same("dim"), "dimension").when(~same("low") | ~same("high"), "norm").when(~same("checksum"), "checksum")
    return j.select("batch", "part", problem.alias("problem")).filter("problem is not null")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/vectors").schema("id long, v array<float>, batch string, part int").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """id, v, batch, part of the index; IndexDamaged if a part is missing, cannot be read, or differs from the manifest."""
    try:
        stated = _manifest(spark, path)
        if check:
            wrong = verify(spark, path).limit(5).collect()
            if wrong:
                raise IndexDamaged("; ".join(f"part {r['part']} of batch {r['batch']}: {r['problem']}" for r in wrong))
        return _rows(spark, path).join(F.broadcast(stated.select("batch").distinct()), "batch", "left_semi")  # a row a batch
    except (PySparkException, Py4JJavaError) as e:  # a file that is no Parquet file, or ends too soon
        raise IndexDamaged(f"{path} cannot be read: {' '.join(str(e).split())[:200]}") from e


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, v of some ids: only their parts' folders are read."""
    parts = _manifest(spark, path).select("parts").first()[0]
    wanted = spark.createDataFrame([(i,) for i in ids], "id long")
    folders = [r[0] for r in wanted.select(_part(parts).alias("part")).distinct().collect()]
    return load(spark, path, check=False).filter(F.col("part").isin(folders)).join(F.broadcast(wanted), "id", "left_semi").select("id", "v")  # as many as asked
