"""Label algebra: policies for uncertain and missing labels, stable logits and losses, decisions and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def apply_policy(raw: Column, uncertain: str = "mask", missing: str = "zero") -> tuple[Column, Column]:
    """(target, mask) of a four-state label. uncertain: zero, one or mask; missing: zero or mask. Another value is an error."""
    if uncertain not in ("zero", "one", "mask") or missing not in ("zero", "mask"):
        raise ValueError(f"unknown policy {uncertain!r}, {missing!r}")
    bad = F.raise_error(F.concat(F.lit("not a label state: "), raw.cast("string"))).cast("double")
    target = F.when(raw == 1, 1.0).when(raw == 0, 0.0).when(raw == -1, 1.0 if uncertain == "one" else 0.0).when(raw.isNull(), 0.0).otherwise(bad)
    mask = F.when(raw == -1, 0 if uncertain == "mask" else 1).when(raw.isNull(), 0 if missing == "mask" else 1).otherwise(1)
    return target, mask


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_sigmoid(z: Column) -> Column:
    return F.when(z >= 0, -F.log1p(F.exp(-z))).otherwise(z - F.log1p(F.exp(z)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q) - F.log1p(-q)


def bce(z: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(pos_weight)
    return -(w * y * log_sigmoid(z) + (1 - y) * log_sigmoid(-z))


def focal(z: Column, y: Column, gamma: float = 2.0, alpha: float | None = None) -> Column:
    logp = y * log_sigmoid(z) + (1 - y) * log_sigmoid(-z)
    loss = -F.pow(1 - F.exp(logp), F.lit(gamma)) * logp
    return loss if alpha is None else loss * (y * alpha + (1 - y) * (1 - alpha))


def asymmetric(z: Column, y: Column, gamma_pos: float = 0.0, gamma_neg: float = 4.0, clip: float = 0.05) -> Column:
    p = F.exp(log_sigmoid(z))
    shifted = F.greatest(p - clip, F.lit(0.0)) if clip > 0 else p
    quiet = F.log(F.greatest(1 - shifted, F.lit(1e-12))) if clip > 0 else log_sigmoid(-z)
    return y * -F.pow(1 - p, F.lit(gamma_pos)) * log_sigmoid(z) + (1 - y) * -F.pow(shifted, F.lit(gamma_neg)) * quiet


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: mean over unmasked rows, 0 if there is none."""
    return F.coalesce(F.avg(F.when(mask == 1, loss)), F.lit(0.0))


def suppress_normal(rows: DataFrame, normal: str, pathologies: list[str], id_col: str = "id") -> DataFrame:
    """Adds `final`: the normal label is off where any pathology is on; nothing else changes."""
    any_bad = F.coalesce(F.bool_or(F.when(F.col("label").isin(pathologies), F.col("decision"))).over(Window.partitionBy(id_col)), F.lit(False))
    return rows.withColumn("final", F.when(F.col("label") == normal, F.col("decision") & ~any_bad).otherwise(F.col("decision")))


def route(positives: Column, normal: Column, devices: list[str]) -> Column:
    """indeterminate (nothing positive, not normal), normal (normal and no pathology) or abnormal."""
    pathologies = F.array_except(positives, F.array(*map(F.lit, devices)))
    return F.when((F.size(positives) == 0) & ~normal, "indeterminate").when(normal & (F.size(pathologies) == 0), "normal").otherwise("abnormal")


def gate_lists(findings: Column) -> tuple[Column, Column]:
    """(passing, failing) names of findings: array of struct(name, positive, p, gate); a null gate always passes."""
    ok = lambda f: f["positive"] & (f["gate"].isNull() | (f["p"] >= f["gate"]))
    low = lambda f: f["positive"] & f["gate"].isNotNull() & (f["p"] < f["gate"])
    return F.transform(F.filter(findings, ok), lambda f: f["name"]), F.transform(F.filter(findings, low), lambda f: f["name"])


def finding_weights(kind: str, p: Column, threshold: Column, over: Column) -> Column:
    """Weights of findings, normalised within `over` (a window partition column): uniform, probability, or margin
    (p - t) / (1 - t) from 0; all zero is uniform."""
    w = {"uniform": F.lit(1.0), "probability": p, "margin": F.greatest(F.try_divide(p - threshold, 1 - threshold), F.lit(0.0))}[kind]
    win = Window.partitionBy(over)
    total = F.sum(w).over(win)
    return F.when(total > 0, w / total).otherwise(1 / F.count(F.lit(1)).over(win))


def support_status(n: Column) -> Column:
    return F.when(n >= 2, "supported").when(n == 1, "partially_supported").otherwise("unsupported")
