"""Helpers shared by the corpus operators: scratch tables in the folder all machines share, and input access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the shingle operators define it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of this machine
    on a local master; on a cluster that is an error, since executors would each write to a disk of their own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the process ends (best effort)."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the folder's owner cleans it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(written: DataFrame) -> None:
    """Remove what materialise wrote, once nothing will be computed from it any more."""
    _remove(written.sparkSession, written.written_at)


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def named(*names: str) -> list[Column]:
    """Columns by their whole names: dots and back quotes in them are part of the name."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def without_names(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Names of df's columns but those that Spark takes for one of `taken`, in whatever case."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def undotted(df: DataFrame) -> DataFrame:
    """df with plain names for columns that mapInArrow cannot name; toDF names them back."""
    return df.toDF(*(f"__c{i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that what is computed from one at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
