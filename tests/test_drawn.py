"""Draws of units, hashed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import resample


def test_drawn_units_have_the_weights_of_every_draw(spark):
    units = spark.range(40).withColumn("unit", F.when(F.col("id") < 35, F.col("id") % 30))  # repeated and null units
    got = resample.drawn(units, "unit", 25)
    want = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("w", resample.weights(F.col("unit"), F.col("b"))).filter("w > 0")
    rows = lambda df: sorted(map(tuple, df.select(F.coalesce("unit", F.lit(-1)), "id", "b", "w").collect()))
    assert rows(got) == rows(want)
