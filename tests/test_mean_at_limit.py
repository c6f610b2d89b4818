"""Means of gains that equal a limit exactly, summed in many orders."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from marlstone.plans import retrieval_queries as Q


@pytest.mark.parametrize(("asked", "held", "outcome", "cause"), [
    (6, [2] * 8 + [1] * 2, "partial", "coverage"),  # (8/3 + 2/6) / 10 = 3/10
    (5, [4] * 5 + [3] * 5, "good", "none"),  # (5 * 4/5 + 5 * 3/5) / 10 = 7/10
])
def test_mean_at_a_limit_meets_it(spark, tmp_path, asked, held, outcome, cause):
    """Ten documents with so many of the asked keys each; items name some documents by a word of their own, which ranks these first."""
    draw = random.Random(7)
    draw.shuffle(held)
    docs = [" ".join([*Q.KEYS[:n], f"d{i}"]) for i, n in enumerate(held)]
    items = [" ".join([*Q.KEYS[:asked], *(f"d{i}" for i in range(10) if draw.random() < 0.5)]) for _ in range(80)]
    pd.DataFrame({"doc_id": range(10), "text": docs}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": range(80), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    got = Q.m8(spark, str(tmp_path)).toPandas()
    assert len(got) == 80
    assert set(zip(got["outcome"], got["cause"])) == {(outcome, cause)}
