"""The tables of a folder as views, and run configurations with checked paths."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # JSON is read without it
    yaml = None

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES, prefix: str = "") -> dict[str, DataFrame]:
    """Lazy readers of the tables, each registered as a temporary view {prefix}{table}."""
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for name, df in found.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return found


@dataclass(frozen=True)
class Config:
    """Named paths and options of a run."""

    paths: dict[str, str] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)

    def path(self, name: str) -> str:
        try:
            return self.paths[name]
        except KeyError:
            raise KeyError(f"no path {name!r}; known: {sorted(self.paths)}") from None


#: What a path that nobody has filled in begins with.
PLACEHOLDERS = ("<", "PATH_TO")


def problems(entries: DataFrame, required: list[str]) -> DataFrame:
    """config, missing, placeholders (names joined by ;, in order of `required`) of the configurations that have any. entries:
    config, key, value; a key may repeat, its largest value counts."""
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key")) for i, k in enumerate(required)])
    given = entries.groupBy("config", "key").agg(F.max("value").alias("value"))
    every = entries.select("config").distinct().select("config", F.explode(wanted).alias("w")).select("config", "w.i", "w.key").join(given, ["config", "key"], "left")
    unset = F.coalesce(F.col("value"), F.lit("")) == ""
    template = F.lit(False)
    for mark in PLACEHOLDERS:
        template = template | F.startswith("value", F.lit(mark))
    named = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("i", "key")))), lambda s: s["key"]), ";")
    found = every.groupBy("config").agg(named(unset).alias("missing"), named(template).alias("placeholders"))
    return found.filter("missing <> '' or placeholders <> ''")


def load_config(file: str | Path, required: tuple[str, ...] = ()) -> Config:
    """A JSON or, where that library is there, YAML file with `paths` and `options`. A required path that is missing, empty or still
    a placeholder is an error, and so is a missing file."""
    text = Path(file).read_text(encoding="utf-8")
    if Path(file).suffix in (".yaml", ".yml"):
        if yaml is None:
            raise RuntimeError("reading YAML needs the yaml library")
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    c = Config(dict(raw.get("paths", {})), dict(raw.get("options", {})))
    for name in required:
        value = c.path(name)
        if not value or value.startswith(PLACEHOLDERS):
            raise ValueError(f"path {name!r} is not set: {value!r}")
    return c
