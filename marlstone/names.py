"""Losses and calibrators by name, and column functions as SQL functions of a session.

The SQL functions are made from the column functions themselves: their expressions, printed as SQL, are the bodies of temporary
functions, which Spark puts in place where they are called. A query that calls them is planned like one that spells them
out: no Python worker, all optimisations.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import assertion, labels, text
from .operators import calibrate

LOSSES: dict[str, Callable[..., Column]] = {"bce": labels.bce, "focal": labels.focal, "asymmetric": labels.asymmetric}
FITTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"temperature": calibrate.fit_temperature, "platt": calibrate.fit_platt, "isotonic": calibrate.fit_isotonic}
MENTIONS = "ARRAY<STRUCT<concept: STRING, match: STRING, status: STRING, sentence: STRING>>"


def _named(table: dict[str, Callable], kind: str, name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def loss(name: str, **options: float) -> Callable[[Column, Column], Column]:
    """The loss of (logit, target) by its name, with its options set. Names and options that are not known are errors."""
    f = _named(LOSSES, "loss", name)
    known = f.__code__.co_varnames[2 : f.__code__.co_argcount]
    if odd := sorted(set(options) - set(known)):
        raise ValueError(f"{name} has no option {', '.join(odd)}; it has {', '.join(known)}")
    return lambda z, y: f(z, y, **options)


def fit(spark: SparkSession, method: str, view: str, into: str) -> DataFrame:
    """Fits a calibrator to a view with columns cls (int), y (0 or 1) and p, and makes the fit a view, so that SQL applies it by a join:
    `into` has a row for each class (isotonic: for each knot)."""
    fitted = _named(FITTERS, "calibrator", method)(calibrate.compact(spark.table(view)))
    fitted.createOrReplaceTempView(into)
    return fitted


def as_sql(x: Column) -> str:
    """The SQL text of an expression. Operators are printed before their operands, so their names are quoted, outside of texts."""
    return re.sub(r"('(?:[^'\\]|\\.)*')|([-+*/%<>=!&|]+)\(", lambda m: m[1] or f"`{m[2]}`(", x._jc.node().sql())


def _functions() -> dict[str, tuple[str, str, Column]]:
    """name -> (parameters, type, body)."""
    z, y, p, raw, c = F.col("z"), F.col("y"), F.col("p"), F.col("raw"), F.col
    score = "z DOUBLE, y DOUBLE"
    found = {
        "sigmoid": ("z DOUBLE", "DOUBLE", labels.sigmoid(z)),
        "log_sigmoid": ("z DOUBLE", "DOUBLE", labels.log_sigmoid(z)),
        "logit": ("p DOUBLE", "DOUBLE", labels.logit(p)),
        "bce_loss": (f"{score}, pos_weight DOUBLE DEFAULT 1.0", "DOUBLE", labels.bce(z, y, c("pos_weight"))),
        "focal_loss": (score, "DOUBLE", labels.focal(z, y)),
        "asymmetric_loss": (score, "DOUBLE", labels.asymmetric(z, y)),
        "temperature_scaled": ("p DOUBLE, t DOUBLE", "DOUBLE", labels.sigmoid(labels.logit(p) / c("t"))),
        "platt_scaled": ("p DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", labels.sigmoid(c("a") * labels.logit(p) + c("b"))),
        "support_status": ("n BIGINT", "STRING", labels.support_status(c("n"))),
        "text_tokens": ("t STRING", "ARRAY<STRING>", text.tokens(c("t"))),
        "token_count": ("t STRING", "INT", text.token_count(c("t"))),
        "text_sentences": ("t STRING", "ARRAY<STRING>", text.sentences(c("t"))),
        "duplicate_key": ("t STRING", "STRING", text.duplicate_key(c("t"))),
        "concept_mentions": ("t STRING", MENTIONS, assertion.mention_list(c("t"))),
    }
    for uncertain in ("zero", "one", "mask"):
        target, mask = labels.apply_policy(raw, uncertain)
        found[f"target_{uncertain}"], found[f"mask_{uncertain}"] = ("raw DOUBLE", "DOUBLE", target), ("raw DOUBLE", "INT", mask)
    return found


def create_function(spark: SparkSession, name: str, parameters: str, returns: str, body: Column) -> None:
    """A temporary SQL function of the session whose body is a column expression over the parameters' names. One that yields an array is
    called in a subquery and taken apart by inline or explode around it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {as_sql(body)}")


def register_functions(spark: SparkSession, lexicon: dict[str, list[str]] | None = None) -> list[str]:
    """Makes the functions known to the session and returns their names. lexicon: the concepts of concept_mentions."""
    found = _functions()
    if lexicon is not None:
        found["concept_mentions"] = ("t STRING", MENTIONS, assertion.mention_list(F.col("t"), lexicon))
    for name, (parameters, returns, body) in found.items():
        create_function(spark, name, parameters, returns, body)
    return sorted(found)
