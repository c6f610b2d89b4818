"""Token shards in training order.

Documents are tokenised and cut into sequences of `width` tokens (the last one padded). A keyed Feistel network with
cycle-walking permutes the numbers of all possible (document, piece) pairs, so each sequence's place in the order is found
where it is made, without counting anything first. Equal ranges of the permuted numbers are shards; since the permutation
spreads evenly, so do the shards, whatever keys or documents are frequent. Each shard is one file of records of the same
number of bytes, in order, so record r begins at r x stride. A sequence's global slot is its shard's first slot plus its
record number: slots are 0 .. number of sequences - 1 without gaps, and any slot is found by one seek. A manifest beside the
shards holds each one's first slot; MOST_SHARDS bounds it, beyond that shards grow.

Tables with null doc_ids, with ids too far apart for that, or with an id on so many rows that one place would fill a good part of
a shard, have their sequences counted and numbered 0 .. n - 1 instead, in order of doc_id (nulls last) and text, and range(n)
is permuted.

Record: doc_id (int64), piece (uint32), length (uint32; its highest bit is set where doc_id is null, which is 0 then), `width`
ids (uint16 or uint32), all little-endian, one newline byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import crc
from .common import discard, materialise, scratch, table
from .tokens import END_ID, default_ranks, ids_of

WIDTH, SHARD_BYTES, MOST_SHARDS, HEAD, UNNAMED = 256, 8 << 20, 1 << 20, 16, 1 << 31
MANIFEST = "_manifest"
#: Records that a task holds as Python objects at a time; parts of a shard that the rows of one doc_id may fill at one place.
MOST_HELD, CROWD = 4096, 4
MASK = (1 << 64) - 1


def _round_keys(key: str, rounds: int = 6) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8] for r in range(rounds)), dtype="<u8")


def feistel(numbers: np.ndarray, domain: int, key: str) -> np.ndarray:
    """A keyed permutation of range(domain), applied to each number: a balanced Feistel network on the next even number of
    bits, walked until the result is inside the domain."""
    half = np.uint64(max(1, ((max(domain, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    x = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        v = x[todo]
        left, right = v >> half, v & mask
        for k in keys:
            z = right + k
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= np.uint64(domain)]
    return x.astype(np.int64)


def stride(width: int, wide: bool = False) -> int:
    return HEAD + width * (4 if wide else 2) + 1


def _in_lots(numbered: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and records, at most MOST_HELD at a time, however many a document or a batch has."""
    while lot := list(islice(numbered, MOST_HELD)):
        numbers, records = zip(*lot)
        yield list(numbers), list(records)


def write_shards(docs: DataFrame, path: str, ranks: str, key: str = "order-0", width: int = WIDTH, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> int:
    """Write the shards under path; returns their number.

    Null and empty texts give one sequence that holds the end id alone. Repeated documents, and rows that repeat a doc_id,
    keep a sequence each (equal places in the order are settled by content). Rows with a null doc_id are documents of their own.
    They, ids that span 2^62 / pieces of the longest text or more, and ids so frequent that their rows' equal places would fill a
    quarter of a shard, cost another exchange and two scratch tables. An empty table writes nothing and returns 0.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    s = slim.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("t")), F.sum(F.octet_length("t")), F.count(F.lit(1)), F.count("doc_id")).first()
    low, high, longest, total, n, named = s
    if not n:
        return 0
    most = ((longest or 0) + 1 + width - 1) // width  # a token has a byte at least
    wide = end_id > 0xFFFF
    size = stride(width, wide)
    domain = (high - low + 1) * most if named == n else 1 << 62
    if domain < 1 << 62 and slim.groupBy("doc_id").count().agg(F.max("count")).first()[0] * size * CROWD > shard_bytes:
        domain = 1 << 62
    shards = max(1, min(MOST_SHARDS, -(-((total or 0) * size // (3 * width) + n * size // 2) // shard_bytes)))  # about three bytes a token, half a sequence of padding
    kind = "<u4" if wide else "<u2"

    def records_of(doc: int, text: str | None, flag: int = 0) -> Iterator[bytes]:
        ids = np.append(ids_of(text, ranks), end_id).astype(kind)
        for piece, at in enumerate(range(0, len(ids), width)):
            part = ids[at : at + width]
            row = np.full(width, end_id, dtype=kind)
            row[: len(part)] = part
            yield np.int64(doc).astype("<i8").tobytes() + np.array([piece, len(part) | flag], dtype="<u4").tobytes() + row.tobytes()

    def deal(numbers: list[int], records: list[bytes], domain: int) -> pd.DataFrame:
        place = feistel(np.array(numbers, dtype=np.uint64), domain, key)
        shard = (place.astype(object) * shards // domain).astype(np.int64) if domain.bit_length() + shards.bit_length() > 62 else place * shards // domain
        return pd.DataFrame({"shard": shard.astype("int32"), "place": place, "record": records})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((doc, text) for b in batches for doc, text in zip(b["doc_id"].tolist(), b["t"]))
        for numbers, records in _in_lots(((doc - low) * most + piece, record) for doc, text in rows for piece, record in enumerate(records_of(doc, text))):
            yield deal(numbers, records, domain)

    if domain < 1 << 62:
        rows = slim.mapInPandas(run, "shard int, place long, record binary")
    else:
        counted = _counted(slim, records_of)
        sizes = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
        starts, total_n = {}, 0
        for part in sorted(sizes):
            starts[part], total_n = total_n, total_n + sizes[part]

        def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield deal([starts[p] + at for p, at in zip(b["part"].tolist(), b["at"].tolist())], b["record"].tolist(), total_n)

        rows = counted.mapInPandas(number, "shard int, place long, record binary")
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "record")  # a range of places in each
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    if domain >= 1 << 62:
        discard(counted)
    _listed(docs.sparkSession, path, size).write.parquet(f"{path}/{MANIFEST}")
    return shards


def _counted(slim: DataFrame, records_of: Callable[..., Iterator[bytes]]) -> DataFrame:
    """part, at, record: the sequences in order of doc_id (nulls last), text and piece; `at` counts from 0 in each part, and parts
    follow one another. Equal rows are told apart by any order, so that many of them are dealt out; the result is the same."""
    named = F.col("doc_id").isNotNull()
    # Nulls go as 0 with a flag: pandas would make floating point of them and of the ids beside them.
    keyed = slim.select((~named).alias("last"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.sha2(F.coalesce("t", F.lit("")), 256).alias("name"), F.monotonically_increasing_id().alias("k"), "t")
    keyed = materialise(keyed, "keyed")
    placed = keyed.repartitionByRange("last", "doc_id", "name", "k").sortWithinPartitions("last", "doc_id", "name", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(b["last"].tolist(), b["doc_id"].tolist(), b["t"]))
        for at, records in _in_lots(enumerate(r for last, doc, text in rows for r in records_of(doc, text, UNNAMED if last else 0))):
            yield pd.DataFrame({"part": np.full(len(records), TaskContext.get().partitionId(), dtype="int32"), "at": at, "record": records})

    counted = materialise(placed.select("last", "doc_id", "t").mapInPandas(run, "part int, at long, record binary"), "counted")
    discard(keyed)
    return counted


def _listed(spark: SparkSession, path: str, size: int) -> DataFrame:
    """shard, file, records, first_slot: one row for each shard, from the files' sizes alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    sized = files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"), F.col("path").alias("file"), (F.col("length") / size).cast("long").alias("records"))
    sized = sized.withColumn("group", F.floor(F.col("shard") / 1024))
    groups = sized.groupBy("group").agg(F.sum("records").alias("s"))
    before = groups.select("group", (F.sum("s").over(Window.orderBy("group")) - F.col("s")).alias("before"))  # MOST_SHARDS / 1024 rows at most
    inside = F.sum("records").over(Window.partitionBy("group").orderBy("shard")) - F.col("records")
    return sized.withColumn("inside", inside).join(before, "group").select("shard", "file", "records", (F.col("before") + F.col("inside")).alias("first_slot"))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """shard, file, records, first_slot of the shards under path; None where an empty table was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("shard int, file string, records long, first_slot long").parquet(f"{path}/{MANIFEST}")


def unpack(content: bytes, width: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """doc_ids, whether they are null, piece numbers, lengths and ids of consecutive records."""
    raw = np.frombuffer(content, dtype=np.uint8).reshape(-1, stride(width, wide))
    head = np.ascontiguousarray(raw[:, :HEAD])
    numbers = head[:, 8:].copy().view("<u4")
    lengths = numbers[:, 1] & (UNNAMED - 1)
    tokens = np.ascontiguousarray(raw[:, HEAD:-1]).view("<u4" if wide else "<u2")
    return head[:, :8].copy().view("<i8").ravel(), numbers[:, 1] >= UNNAMED, numbers[:, 0], lengths, [x[:k] for x, k in zip(tokens, lengths)]


def read_slots(spark: SparkSession, path: str, first: int = 0, count: int | None = None, width: int = WIDTH, wide: bool = False, digest: bool = False) -> DataFrame:
    """The sequences of slots first .. first + count - 1 (all from first, if count is None): slot, shard, doc_id, piece,
    length and ids, or with digest the CRC-32 of the ids as little-endian unsigned 32-bit integers. Shards that hold none of
    them are not opened."""
    size = stride(width, wide)
    schema = "slot long, shard int, doc_id long, piece int, length int, " + ("ids_crc32 long" if digest else "ids array<int>")
    last = (1 << 62) if count is None else first + count
    listed = manifest(spark, path)
    wanted = None if listed is None else listed.filter((F.col("first_slot") < last) & (F.col("first_slot") + F.col("records") > first)).select("shard", "first_slot").toArrow().to_pandas()  # MOST_SHARDS rows at most
    if wanted is None or wanted.empty:
        return spark.createDataFrame([], schema)
    low, high = int(wanted["shard"].min()), int(wanted["shard"].max())
    begins = np.zeros(high - low + 1, dtype=np.int64)
    begins[wanted["shard"] - low] = wanted["first_slot"]
    shared = spark.sparkContext.broadcast(begins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, content in zip(b["shard"].tolist(), b["content"]):
                begin = int(shared.value[shard - low])
                lo, hi = max(0, first - begin), min(len(content) // size, last - begin)
                for s in range(lo, hi, 4096):
                    e = min(hi, s + 4096)
                    docs, unnamed, pieces, lengths, ids = unpack(content[s * size : e * size], width, wide)
                    values = {"ids_crc32": [crc(x.astype("<u4").tobytes()) for x in ids]} if digest else {"ids": [x.astype("int32") for x in ids]}
                    yield pd.DataFrame({"slot": begin + np.arange(s, e), "shard": shard, "doc_id": pd.arrays.IntegerArray(docs, unnamed), "piece": pieces.astype("int32"), "length": lengths.astype("int32")} | values)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter(F.col("shard").between(low, high)).select(F.col("shard").cast("int").alias("shard"), "content")
    return files.mapInPandas(run, schema)


def resume(spark: SparkSession, path: str, slot: int, count: int = 1, width: int = WIDTH, wide: bool = False) -> list[tuple[int, int | None, int, list[int]]]:
    """(slot, doc_id, piece, ids) of up to `count` sequences from `slot` on, up to the end of its shard: one seek and one read in
    this process, for a reader that goes on where it stopped. None are left beyond the last slot."""
    listed = manifest(spark, path)
    found = listed and listed.filter((F.col("first_slot") <= slot) & (F.col("first_slot") + F.col("records") > slot)).first()
    if not found:
        return []
    size, jvm = stride(width, wide), spark.sparkContext._jvm
    n = min(count, found["first_slot"] + found["records"] - slot)
    at = jvm.org.apache.hadoop.fs.Path(found["file"])
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek((slot - found["first_slot"]) * size)
        content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * size))
    finally:
        stream.close()
    docs, unnamed, pieces, _, ids = unpack(content, width, wide)
    return [(slot + k, None if u else int(d), int(p), x.tolist()) for k, (d, u, p, x) in enumerate(zip(docs, unnamed, pieces, ids))]


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path, default_ranks())
    return read_slots(spark, path, digest=True)
