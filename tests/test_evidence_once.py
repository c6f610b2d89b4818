"""A summary's words are taken once, however often they are used."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import agents


def test_summary_takes_words_once(spark):
    df = spark.createDataFrame([("one two", [1]), ("", [1, 2]), (None, []), (" ".join(map(str, range(30))), [1])], "s string, r array<int>")
    made = df.select(agents._summary(F.col("s"), F.col("r"), F.lit(5), F.array(F.lit("a b c d e f"))).alias("x")).select("x.*")
    assert sorted(map(tuple, made.collect())) == sorted([("one two", False, False), ("Stated in 2 of 5 retrieved reports.", False, True), ("Not stated in any retrieved report.", False, True), (" ".join(map(str, range(20))), True, False)])
    one = df.select(agents._summary(F.col("s"), F.col("r"), F.lit(5), F.array(F.lit("a b c d e f"))).alias("x"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
