"""File sources and sinks: listings, JSON lines, vectors, lossless CSV, canonical JSON. Scratch paths are in the folder that
driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, removed when the process ends. Where that is unset, a temporary folder of this
    machine on a local master; on a cluster that is an error, since every executor would write to a disk of its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, if the session still can."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder's owner cleans it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; its attribute written_at is the path."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Remove what `written` wrote, once nothing will be computed from it any more."""
    remove(table.sparkSession, table.written_at)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, file, bytes, modified of every file under root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


#: Bytes of a file that are held at a time while it is hashed.
BLOCK_BYTES = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


def streams(found: DataFrame) -> bool:
    """Whether tasks can open the files found as streams. Where only Spark's readers can (a mount table of its own, say), contents
    are rows."""
    first = found.select("_metadata.file_path").first()
    try:
        return first is not None and located(first[0])[0].get_file_info(located(first[0])[1]).type == fs.FileType.File
    except (pa.ArrowException, OSError):
        return False


def digest(uri: str, whole: Callable[[bytes], bool] = lambda head: False) -> tuple[str, bytes]:
    """SHA-256 of a file, a block in memory at a time, and its first block: all of it, if `whole` says so of that block."""
    system, at = located(uri)
    h, kept = hashlib.sha256(), []
    with system.open_input_stream(at, compression=None) as f:
        while block := f.read(BLOCK_BYTES):
            h.update(block)
            if not kept or whole(kept[0]):
                kept.append(block)
    return h.hexdigest(), b"".join(kept)


def audit_files(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256, empty: contents are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if not streams(f):
        return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.col("length") == 0).alias("empty"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sha256=[digest(u)[0] for u in b["uri"]]).drop(columns="uri")

    hashed = f.select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("uri")).mapInPandas(run, "path string, bytes long, sha256 string")
    return hashed.select("path", "bytes", "sha256", (F.col("bytes") == 0).alias("empty"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files that are missing, new or changed against a manifest (path, sha256)."""
    m = manifest.select("path", F.col("sha256").alias("stated"))
    j = files.select("path", "sha256").join(m, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("stated").isNull(), "new").when(F.col("sha256") != F.col("stated"), "changed")
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lossless(x: Column) -> Column:
    """A double as text that reads back to the same double."""
    return F.format_string("%.17g", x)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubles at 17 digits; gzip files."""
    cols = [lossless(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("header", "true").option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with its columns in order of name; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
