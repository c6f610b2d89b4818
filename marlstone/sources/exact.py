"""Text files whose bytes depend on the rows alone: not on partitions, machines or the time of writing.

Lines are put in order and cut into parts where their running size passes a multiple of `part_bytes`, so that the parts are the same
however Spark dealt out the rows. Each part is compressed by one task, as a gzip member without a time. Tasks write under names of
their own; the commit gives the parts of finished tasks their final names and then writes the manifest, so that tasks that were
lost or ran twice leave nothing behind and a folder without a manifest is not complete. Members one after another are a gzip file too:
`join_parts` makes one of a folder.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from .files import canonical_json, discard, lossless, written

FORMAT, MANIFEST, HEADER, PART_BYTES = "marlstone_parts", "_manifest.json", "_header.gz", 64 << 20
#: Bytes of text that move as one row.
BLOCK_BYTES = 64 << 10
MEMBERS = "part long, rows long, content binary"


class PartsDamaged(ValueError):
    """Parts that are missing, changed or not in the manifest."""


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


def _put(path: str, content: bytes) -> None:
    system, at = _at(path)
    with system.open_output_stream(at, compression=None) as out:
        out.write(content)


def _name(part: int, suffix: str) -> str:
    return f"part-{part:09d}{suffix}"


@dataclass
class _Done(WriterCommitMessage):
    parts: list[tuple[int, int, int, str, str]]  # part, rows, bytes, SHA-256, temporary path


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".gz")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        done, folder = [], f"{self.path}/_writing-{self.run}"
        system, at = _at(folder)
        system.create_dir(at, recursive=True)
        for row in iterator:
            content, at = bytes(row["content"]), f"{folder}/{uuid.uuid4().hex}"
            _put(at, content)
            done.append((row["part"], row["rows"], len(content), hashlib.sha256(content).hexdigest(), at))
        return _Done(done)

    def commit(self, messages: list) -> None:
        system, at = _at(self.path)
        listed = sorted(p for m in messages if m is not None for p in m.parts)  # an entry for each part
        for part, _, _, _, temporary in listed:
            system.move(_at(temporary)[1], f"{at}/{_name(part, self.suffix)}")
        self.abort(messages)
        entries = [{"bytes": n, "file": _name(part, self.suffix), "rows": rows, "sha256": digest} for part, rows, n, digest, _ in listed]
        _put(f"{self.path}/{MANIFEST}", json.dumps(entries, sort_keys=True, separators=(",", ":")).encode())

    def abort(self, messages: list) -> None:
        system, at = _at(f"{self.path}/_writing-{self.run}")
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class Parts(DataSource):
    """A sink for the columns of MEMBERS."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one range, in order, as blocks of text of about BLOCK_BYTES: where a block begins in its range and its lines in it."""
    begins = 0
    for b in batches:
        ended = pc.binary_join_element_wise(b.column("line"), "", "\n")
        sizes = pc.binary_length(ended).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        starts, text = ends - sizes, ended.buffers()[2]
        firsts = np.flatnonzero(np.diff(starts // BLOCK_BYTES, prepend=-1))
        bounds = np.append(firsts, len(starts))
        at = np.append(starts[firsts], ends[-1:])
        within = starts - np.repeat(starts[firsts], np.diff(bounds))
        columns = [b.column("range").take(pa.array(firsts)), pa.array(begins + starts[firsts]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(within.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([text.slice(x, y - x).to_pybytes() for x, y in zip(at.tolist(), at[1:].tolist())], pa.binary())], names=["range", "begins", "size", "starts", "text"])
        begins += int(sizes.sum())


def _cut(lines: DataFrame, part_bytes: int) -> DataFrame:
    """part, begins, rows, text: pieces of parts. lines: line and, before it, columns to sort by. Lines are joined to blocks within ranges of the order, so that
    only blocks move from then on, and the ranges' sizes, a row for each, added before them. Equal lines of one place may swap, which changes
    nothing; so they are dealt out too."""
    keyed = written(lines.withColumn("k", F.monotonically_increasing_id()), "lines")
    spread = keyed.repartitionByRange(*keyed.columns).sortWithinPartitions(*keyed.columns)
    blocks = written(spread.select(F.spark_partition_id().alias("range"), "line").mapInArrow(_blocks, "range int, begins long, size long, starts array<int>, text binary"), "blocks")
    sizes = blocks.groupBy("range").agg(F.sum("size").alias("s"))
    before = sizes.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))  # a row for each range
    placed = blocks.join(F.broadcast(before), "range").withColumn("base", F.col("before") + F.col("begins"))  # a row for each range
    # A part has the lines that begin in it.
    first, last = F.floor(F.col("base") / part_bytes), F.floor((F.col("base") + F.element_at("starts", -1)) / part_bytes)
    part, base = F.col("part"), F.col("base")
    own = lambda x: (base + x >= part * part_bytes) & (base + x < (part + 1) * part_bytes)
    whole = first == last  # most blocks
    pieces = placed.withColumn("part", F.explode(F.sequence(first, last))).withColumn("own", F.when(whole, F.col("starts")).otherwise(F.filter("starts", own))).filter(F.size("own") > 0)
    after = F.coalesce(F.when(~whole, F.array_min(F.filter("starts", lambda x: base + x >= (part + 1) * part_bytes))), F.col("size").cast("int"))
    start = F.element_at("own", 1)
    out = pieces.select("part", (base + start).alias("begins"), F.size("own").alias("rows"), F.substring("text", start + 1, after - start).alias("text"))
    out.scratch = (keyed, blocks)
    return out


def _compressed(pieces: pd.DataFrame) -> pd.DataFrame:
    text = b"".join(pieces.sort_values("begins")["text"])
    return pd.DataFrame({"part": pieces["part"].iloc[:1], "rows": [pieces["rows"].sum()], "content": [gzip.compress(text, 9, mtime=0)]})


def write_lines(df: DataFrame, line: Column, order: list[str], path: str, header: str | None = None, part_bytes: int = PART_BYTES, suffix: str = ".gz") -> None:
    """Write `line` of each row in order of the columns `order` (nulls first), then of the line itself. A null line is an error; an empty table
    is a folder without parts. A folder that has a manifest is not written again."""
    spark = df.sparkSession
    system, at = _at(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(at, recursive=True)
    for f in system.get_file_info(fs.FileSelector(at)):  # what a commit that was cut off left
        if f.base_name.startswith("part-"):
            system.delete_file(f.path)
    spark.dataSource.register(Parts)
    checked = F.coalesce(line, F.raise_error(F.lit("a line is null")).cast("string"))
    cut = _cut(df.select(*(F.col(c).alias(f"by{i}") for i, c in enumerate(order)), checked.alias("line")), part_bytes)
    if header is not None:
        _put(f"{path}/{HEADER}", gzip.compress(f"{header}\n".encode(), 9, mtime=0))
    cut.groupBy("part").applyInPandas(_compressed, MEMBERS).write.format(FORMAT).option("path", path).option("suffix", suffix).mode("append").save()
    for table in cut.scratch:
        discard(table)


def finite(df: DataFrame, unknown: str = "error") -> DataFrame:
    """df with NaN and infinite numbers refused ("error") or made null ("null")."""
    if unknown not in ("error", "null"):
        raise ValueError(f"unknown rule {unknown!r}")
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    other = lambda c: F.raise_error(F.lit(f"{c} is not finite")) if unknown == "error" else F.lit(None)
    return df.withColumns({c: F.when(odd(F.col(c)), other(c).cast(t)).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")} or {})


def write_json(df: DataFrame, order: list[str], path: str, unknown: str = "error", part_bytes: int = PART_BYTES) -> None:
    """Canonical JSON lines (keys in order of name, nulls kept, only finite numbers)."""
    safe = finite(df, unknown)
    write_lines(safe, canonical_json(safe), order, path, None, part_bytes, ".json.gz")


def write_csv(df: DataFrame, order: list[str], path: str, part_bytes: int = PART_BYTES) -> None:
    """CSV with doubles at 17 digits, quoted where a value needs it; the header is a file of its own, which readers of the folder skip. Values with
    line ends are kept in quotes: read with multiLine."""
    text = F.to_csv(F.struct(*[lossless(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))
    write_lines(df, text, order, path, ",".join(df.columns), part_bytes, ".csv.gz")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, bytes, sha256 (of the lines, unpacked) of the files of a folder. What differs from the manifest is an error."""
    system, at = _at(path)
    try:
        with system.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
            listed = json.loads(f.read())
    except FileNotFoundError:
        raise PartsDamaged(f"{path} has no manifest") from None
    stated = spark.createDataFrame([(e["file"], e["rows"], e["sha256"]) for e in listed], "file string, stated_rows long, stated string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, packed in zip(b["file"], b["content"]):
                text = gzip.decompress(packed)
                yield pd.DataFrame({"file": [file], "packed": [hashlib.sha256(packed).hexdigest()], "rows": [text.count(b"\n")], "bytes": [len(text)], "sha256": [hashlib.sha256(text).hexdigest()]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    both = found.mapInPandas(run, "file string, packed string, rows long, bytes long, sha256 string").join(stated, "file", "full")
    same = F.col("packed").eqNullSafe(F.col("stated")) & F.col("packed").isNotNull()
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    checked = F.when(same, part).otherwise(F.raise_error(F.concat(F.lit("not as in the manifest: "), "file")).cast("long"))
    return both.select(checked.alias("part"), "rows", "bytes", "sha256")


def join_parts(path: str, file: str) -> None:
    """One gzip file of a folder's header and parts, in order: streamed, a few megabytes in memory at a time, by this process."""
    system, at = _at(path)
    with system.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
        names = [e["file"] for e in json.loads(f.read())]
    if system.get_file_info(f"{at}/{HEADER}").type == fs.FileType.File:
        names.insert(0, HEADER)
    into, to = _at(file)
    with into.open_output_stream(to, compression=None) as out:
        for name in names:
            with system.open_input_stream(f"{at}/{name}", compression=None) as f:
                while block := f.read(4 << 20):
                    out.write(block)
