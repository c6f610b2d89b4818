"""Files with the same bytes for any partitioning, their commit and their verification."""

from __future__ import annotations

import gzip
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.sources import exact


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    data = [(r.choice([None, *range(40)]), r.choice(["a", "b,c", 'say "so"', "é", "", None]), r.choice([0.1, 1 / 3, -0.0, 1e300, None])) for _ in range(700)]
    return data + [(7, "again", 0.5)] * 600


def bytes_of(folder: Path) -> dict[str, bytes]:
    return {f.name: f.read_bytes() for f in folder.iterdir() if not f.name.endswith(".crc")}


def test_equal_bytes_for_any_partitioning(spark, rows, tmp_path):
    schema, seen = "k int, s string, x double", []
    for i, parts in enumerate((1, 8, 3)):
        data = list(rows)
        random.Random(i).shuffle(data)
        df = spark.createDataFrame(data, schema).repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(1 + 3 * i))
        try:
            exact.write_csv(df, ["k"], f"{tmp_path}/csv{i}", part_bytes=2000)
            exact.write_json(df, ["s", "k"], f"{tmp_path}/json{i}", part_bytes=2000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        exact.join_parts(f"{tmp_path}/csv{i}", f"{tmp_path}/one{i}.csv.gz")
        seen.append((bytes_of(tmp_path / f"csv{i}"), bytes_of(tmp_path / f"json{i}"), (tmp_path / f"one{i}.csv.gz").read_bytes()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 8 and not any(n.startswith("_writing") for n in seen[0][0])
    lines = gzip.decompress(seen[0][2]).decode().splitlines()
    assert lines[0] == "k,s,x" and len(lines) == 1301
    order = [int(x.split(",")[0] or -1) if not x.startswith('"') else -1 for x in lines[1:]]
    assert order == sorted(order)
    read = spark.read.schema(schema).option("escape", "\\").csv(f"{tmp_path}/csv0")
    assert read.count() == 1300 and read.filter("s = 'b,c'").count() == sum(s == "b,c" for _, s, _ in rows)
    assert Counter(r["x"] for r in read.collect()) == Counter(x for *_, x in rows)  # the very same doubles
    parsed = [json.loads(x) for n, c in sorted(seen[0][1].items()) if n.startswith("part") for x in gzip.decompress(c).decode().splitlines()]
    key = lambda t: tuple((v is not None, v) for v in t)
    assert sorted(((p["k"], p["s"], p["x"]) for p in parsed), key=key) == sorted(rows, key=key) and list(parsed[0]) == ["k", "s", "x"]


def test_parts_are_cut_by_size_and_verified(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("line"))
    at = f"{tmp_path}/lines"
    exact.write_lines(df, F.col("line"), ["id"], at, part_bytes=1000)
    got = [tuple(r)[:3] for r in exact.read_parts(spark, at).orderBy("part").collect()]
    assert got == [(i, 100, 1000) for i in range(10)]
    with pytest.raises(FileExistsError):
        exact.write_lines(df, F.col("line"), ["id"], at)
    (Path(at) / "part-000000003.gz").write_bytes(gzip.compress(b"other\n"))
    with pytest.raises(Exception, match="not as in the manifest"):
        exact.read_parts(spark, at).collect()
    (Path(at) / "part-000000003.gz").unlink()
    with pytest.raises(Exception, match="not as in the manifest"):
        exact.read_parts(spark, at).collect()


def test_failed_and_empty_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, x double")
    with pytest.raises(Exception, match="not finite"):
        exact.write_json(df, ["k"], f"{tmp_path}/a")
    with pytest.raises(exact.PartsDamaged):
        exact.read_parts(spark, f"{tmp_path}/a")
    (tmp_path / "a" / "part-000000099.json.gz").write_bytes(b"left by a commit that was cut off")
    exact.write_json(df, ["k"], f"{tmp_path}/a", unknown="null")
    assert gzip.decompress((tmp_path / "a" / "part-000000000.json.gz").read_bytes()) == b'{"k":1,"x":null}\n{"k":2,"x":0.5}\n'
    assert exact.read_parts(spark, f"{tmp_path}/a").count() == 1
    exact.write_csv(df.limit(0), ["k"], f"{tmp_path}/none")
    exact.join_parts(f"{tmp_path}/none", f"{tmp_path}/none.csv.gz")
    assert gzip.decompress((tmp_path / "none.csv.gz").read_bytes()) == b"k,x\n" and exact.read_parts(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="a line is null"):
        exact.write_lines(df, F.lit(None).cast("string"), ["k"], f"{tmp_path}/null")


def test_blocks_move_instead_of_lines(spark, tmp_path, monkeypatch):
    """Lines are joined before they meet their part; where blocks and parts are cut changes no byte. Lines longer than a block or a part, empty
    ones and ones with line ends of their own."""
    texts = [["", "x", "é\nü", "long" * 40, "\n", "y" * 7][i % 6] for i in range(500)]
    df = spark.createDataFrame([(i // 3, t) for i, t in enumerate(texts)], "id int, line string").repartition(3)
    ordered = b"".join(f"{t}\n".encode() for _, t in sorted((i // 3, t.encode()) for i, t in enumerate(texts)) for t in [t.decode()])
    cut = exact._cut(df.select(F.col("id").alias("order"), "line"), 1 << 20)
    assert cut.agg(F.sum("rows")).first()[0] == 500 and cut.count() < 50
    seen = []
    for size in (exact.BLOCK_BYTES, 64):
        monkeypatch.setattr(exact, "BLOCK_BYTES", size)
        exact.write_lines(df, F.col("line"), ["id"], f"{tmp_path}/{size}", part_bytes=100)
        found = bytes_of(tmp_path / str(size))
        assert b"".join(gzip.decompress(c) for n, c in sorted(found.items()) if n.startswith("part")) == ordered
        begins, parts = 0, set()
        for _, t in sorted((i // 3, t.encode()) for i, t in enumerate(texts)):
            parts.add(f"part-{begins // 100:09d}.gz")
            begins += len(t) + 1
        assert {n for n in found if n.startswith("part")} == parts
        seen.append(found)
    assert seen[0] == seen[1]
