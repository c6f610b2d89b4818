"""Components, exact quantiles, difference hashes and their radius join, the index folder: against plain versions."""

from __future__ import annotations

import os
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, images, ordered
from marlstone.sources import vectors


# ---- components
def plain_components(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            low = min(label[a], label[b])
            label[a] = label[b] = low
    return label


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(700, 700), (1, 1), (900, 899), (900, 899)]
    edges = spark.createDataFrame(pairs + [(None, 3), (4, None)], "a long, b long")
    assert {x["node"]: x["label"] for x in graph.components(edges).collect()} == plain_components(pairs)
    names = spark.createDataFrame([("b", "c"), ("x", "y"), ("c", "a")], "a string, b string")
    assert {x["node"]: x["label"] for x in graph.components(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.components(edges.limit(0)).count() == 0


def test_hub_is_dealt_out(spark):
    """The edges of a hub meet its smallest neighbour in as many tasks as their own are."""
    star = spark.range(1, 20_001, numPartitions=8).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    least = spark.createDataFrame([(0, 0)], "a long, m long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        per = [x["count"] for x in ordered.attach(star, least, ["a"]).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(per) == 20_000 and max(per) <= 20_000 / 2
    assert graph.components(star).filter("label <> 0").count() == 0


# ---- quantiles
def test_quantiles(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.normal(size=3000)] + [("b", 1.0)] * 500 + [("b", 2.0)] + [("c", 7.5)] + [(None, float(x)) for x in range(10)] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double").cache()
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for share in (50, 1 << 17):
        got = {x["k"]: x["q"] for x in ordered.quantiles(df, ["k"], "x", qs, share).collect()}
        assert set(got) == {"a", "b", "c", None}
        for k, q in got.items():
            np.testing.assert_allclose(q, np.quantile([x for g, x in rows if g == k and x is not None], qs), rtol=1e-12)
    assert ordered.quantiles(df, [], "x", [0.5]).count() == 1 and ordered.quantiles(df.limit(0), [], "x", [0.5]).first()["q"] is None and ordered.quantiles(df.limit(0), ["k"], "x", [0.5]).count() == 0


# ---- difference hashes
def png(pixels: np.ndarray) -> bytes:
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[pixels.shape[2]]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_resize_and_hash():
    r = np.random.default_rng(2)
    flat = np.full((50, 70, 1), 130, np.uint8)
    assert (images.resize(images.grey_of(flat), 9, 8) == 130).all() and images.dhash(flat) == "0" * 16
    rising = np.tile(np.arange(0, 250, 2, dtype=np.uint8)[None, :, None], (90, 1, 1))
    assert images.dhash(rising) == "f" * 16 and images.dhash(rising[:, ::-1], 16) == "0" * 64
    # Each new sample is the mean of old ones weighted by a triangle.
    x = r.integers(0, 256, (1, 37)).astype(np.uint8)
    scale = 37 / 9
    for i, v in enumerate(images.resize(x, 9, 1)[0]):
        w = [max(0.0, 1 - abs(j + 0.5 - (i + 0.5) * scale) / scale) for j in range(37)]
        assert abs(v - np.dot(w, x[0]) / sum(w)) <= 0.51
    assert (images.resize(x, 37, 1) == x).all()
    colour = r.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    assert images.dhash(np.dstack([colour, np.zeros((40, 40, 1), np.uint8)])) == images.dhash(colour)


def test_audited_files_have_hashes_and_perceptual_groups(spark, tmp_path):
    r = np.random.default_rng(3)
    y, x = np.mgrid[0:120, 0:160] / 40
    base = np.sin(2 * x + y) + np.cos(3 * y - x) * np.sin(x * y)
    base = np.uint8(255 * (base - base.min()) / (np.ptp(base) + 1e-9))[:, :, None]
    near = np.clip(base.astype(int) + r.integers(-2, 3, base.shape), 0, 255).astype(np.uint8)
    other = r.integers(0, 256, (100, 100, 1), dtype=np.uint8)
    for name, data in {"a.png": png(base), "b.png": png(base[::2, ::2]), "c.png": png(near), "d.png": png(other), "e.png": png(base), "f.png": b"not an image"}.items():
        (tmp_path / name).write_bytes(data)
    got = images.audit_images(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = {x["file"]: x for x in got.collect()}
    assert rows["f.png"]["dhash"] is None and len(rows["a.png"]["dhash256"]) == 64 and rows["a.png"]["dhash256"] == rows["e.png"]["dhash256"]
    groups = {x["id"]: x["label"] for x in images.perceptual_groups(got.select(F.col("file").alias("id"), F.col("dhash").alias("hash")), 8, 64).collect()}
    assert set(groups) == {"a.png", "b.png", "c.png", "d.png", "e.png"}
    assert groups["a.png"] == groups["b.png"] == groups["c.png"] == groups["e.png"] != groups["d.png"]


@pytest.mark.parametrize("bits, radius, equal", [(64, 0, 1), (64, 3, 1), (64, 6, 2), (256, 12, 2), (32, 5, 3)])
def test_radius_join_equals_all_pairs(spark, bits, radius, equal):
    r = random.Random(bits + radius)
    base = [r.getrandbits(bits) for _ in range(25)] + [0, (1 << bits) - 1]
    values = set(base)
    for b in base:
        for k in range(1, radius + 3):
            for _ in range(2):
                v = b
                for i in r.sample(range(bits), k):
                    v ^= 1 << i
                values.add(v)
    hashes = {v: f"{v:0{bits // 4}x}" for v in values}
    want = {(hashes[a], hashes[b], bin(a ^ b).count("1")) for a in values for b in values if hashes[a] < hashes[b] and bin(a ^ b).count("1") <= radius}
    df = spark.createDataFrame([(h,) for h in hashes.values()] + [(None,), ("ff",)], "hash string")
    got = [tuple(x) for x in images.near_hashes(df, radius, bits, equal).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---- index folder
@pytest.fixture
def index(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(r.normal(size=(300, 8)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    at = f"{tmp_path}/index"
    vectors.append(df.filter("id < 200"), at, parts=4, unit=True)
    vectors.append(df.filter("id >= 200"), at, parts=99, unit=True)
    return df, at


def test_index_round_trip(spark, index):
    df, at = index
    got = vectors.load(spark, at)
    assert got.select("id", "v").exceptAll(df.select("id", F.transform("v", lambda x: x.cast("float")).alias("v"))).count() == 0 and got.count() == 300
    assert spark.read.parquet(f"{at}/manifest").select("parts").distinct().collect()[0][0] == 4
    some = vectors.look_up(spark, at, [5, 250, 9999])
    assert sorted(x["id"] for x in some.collect()) == [5, 250]
    assert "PartitionFilters: [part" in vectors.look_up(spark, at, [5])._jdf.queryExecution().toString().replace("isnotnull(part#", "part#") or "part" in vectors.look_up(spark, at, [5])._jdf.queryExecution().toString()
    # A batch without manifest rows is not part of the index.
    df.limit(3).withColumn("id", F.col("id") + 5000).withColumns({"batch": F.lit("lost"), "part": F.lit(1)}).select("id", F.col("v").cast("array<float>").alias("v"), "batch", "part").write.mode("append").partitionBy("batch", "part").parquet(f"{at}/vectors")
    assert vectors.load(spark, at).count() == 300


def test_index_refuses(spark, index):
    df, at = index
    for bad in ([(1, [1.0] + [0.0] * 7)], [(900, [1.0, 0.0])], [(900, None)], [(900, [float("nan")] * 8)], [(None, [1.0] + [0.0] * 7)], [(900, [2.0] + [0.0] * 7)], [(900, [1.0] + [0.0] * 7)] * 2):
        with pytest.raises(ValueError):
            vectors.append(spark.createDataFrame(bad, "id long, v array<double>"), at, unit=True)
    vectors.append(df.limit(0), at)
    assert vectors.load(spark, at).count() == 300


@pytest.mark.parametrize("damage", ["missing", "short", "changed", "double"])
def test_index_damage_is_an_error(spark, index, damage):
    _, at = index
    part = next(p for p in sorted(Path(at, "vectors").rglob("*.parquet")))
    if damage == "missing":
        part.unlink()
    elif damage == "short":
        data = part.read_bytes()
        os.truncate(part, len(data) // 2)
        Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    else:
        rows = spark.read.parquet(str(part)).collect()
        rows = rows + rows[:1] if damage == "double" else [(rows[0]["id"], [x + 1e-4 for x in rows[0]["v"]])] + rows[1:]
        other = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
        other.write.parquet(f"{at}-other")
        new = next(Path(f"{at}-other").glob("*.parquet"))
        part.write_bytes(new.read_bytes())
        Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    spark.catalog.clearCache()
    with pytest.raises(vectors.IndexDamaged):
        vectors.load(spark, at)
