"""A store of answers to requests, kept by a stream that can be stopped and started again at any time.

Requests have an id, a time, their parameters' hash (incremental.request_key) and the number of the attempt. The stream answers
each attempt of a request once: repeated rows go by state within the watermark, later ones by the store itself, and rows older
than the watermark are late and left out. A micro-batch writes a folder of its own number, over whatever an interrupted run of
the same batch left there, so a restart neither loses nor doubles an answer. Failures are kept as such and never taken for results:
the request is open until an attempt of a higher number succeeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

SUCCESS = "success"
STORED = "id string, request_hash string, at timestamp, attempt int, status string, response string, batch long"
KEY = ["id", "request_hash"]


def _folder(spark: SparkSession, path: str) -> str:
    """The folder of the batches, made if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/answers")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return f"{path}/answers"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All answers, failures too, with the number of the batch that wrote them."""
    return spark.read.schema(STORED).option("basePath", _folder(spark, path)).parquet(_folder(spark, path))


def results(spark: SparkSession, path: str) -> DataFrame:
    """The answer of each request that has one: the first successful attempt."""
    first = Window.partitionBy(*KEY).orderBy("attempt", "batch")
    return stored(spark, path).filter(F.col("status") == SUCCESS).withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn")


def open_requests(spark: SparkSession, path: str) -> DataFrame:
    """id, request_hash, attempt of the next try: requests that were answered, but never with success."""
    g = stored(spark, path).groupBy(*KEY).agg(F.max("attempt").alias("last"), F.bool_or(F.col("status") == SUCCESS).alias("done"))
    return g.filter("not done").select(*KEY, (F.col("last") + 1).cast("int").alias("attempt"))


def keep_answers(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, late: str = "1 hour", **trigger: object) -> StreamingQuery:
    """Starts the stream. requests: a streaming table with id, request_hash, at, attempt and whatever `answer` needs; rows without an id, hash or
    time take no part, a null attempt is the first. answer: a table of requests to one with KEY, at, attempt, status and response; it is asked
    only for requests that have no stored success, once a micro-batch. trigger: as of writeStream.trigger (default: availableNow).
    """
    spark = requests.sparkSession
    _folder(spark, path)
    whole = requests.filter("id is not null and request_hash is not null and at is not null").withColumn("attempt", F.coalesce(F.col("attempt").cast("int"), F.lit(0)))
    once = whole.withWatermark("at", late).dropDuplicatesWithinWatermark([*KEY, "attempt"])

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        latest = Window.partitionBy(*KEY).orderBy(F.desc("attempt"), "at")
        asked = batch.withColumn("turn", F.row_number().over(latest)).filter("turn = 1").drop("turn")
        done = stored(session, path).filter((F.col("status") == SUCCESS) & (F.col("batch") != number)).select(*KEY).distinct()
        made = answer(asked.join(done, KEY, "left_anti"))
        made.select("id", "request_hash", "at", "attempt", "status", "response").write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
