"""The answer store: late, repeated and failed requests, and a stream that dies between and within batches."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marlstone.operators import textgen
from marlstone.streaming import incremental, results

NOON = datetime(2024, 5, 1, 12)
SCHEMA = "id string, question string, at timestamp, attempt int"


def put(folder, name, rows):
    """A file of requests: (id, question, minutes from noon, attempt)."""
    lines = [json.dumps({"id": i, "question": q, "at": None if m is None else (NOON + timedelta(minutes=m)).isoformat(), "attempt": a}) for i, q, m, a in rows]
    (folder / f"{name}.json").write_text("\n".join(lines))


def start(spark, at, dies=None):
    """The stream over the folder, a file a batch; answers are upper-cased questions, failures those with a question mark at their first attempt.
    dies: an id at which the batch breaks after its answers were computed in part."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(at / "in"))
    requests = source.withColumn("request_hash", incremental.request_key({"question": F.col("question")}))

    def answer(asked):
        bad = F.col("question").contains("?") & (F.col("attempt") == 0)
        broken = F.when(F.col("id") == dies, F.raise_error(F.lit("lost"))).otherwise(F.upper("question"))
        return asked.withColumn("status", F.when(bad, "error").otherwise(results.SUCCESS)).withColumn("response", F.when(~bad, broken))

    return results.keep_answers(requests, answer, str(at / "out"), str(at / "checkpoint"), "30 minutes")


@pytest.fixture
def at(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def answers(spark, at):
    return sorted((r["id"], r["response"], r["attempt"]) for r in results.results(spark, str(at / "out")).collect())


def test_late_repeated_and_failed(spark, at):
    put(at / "in", "1", [("a", "one", 0, 0), ("a", "one", 1, 0), ("b", "why?", 2, 0), (None, "x", 3, 0), ("c", "two", None, 0)])
    start(spark, at).awaitTermination()
    assert answers(spark, at) == [("a", "ONE", 0)]
    assert [(r["id"], r["attempt"]) for r in results.open_requests(spark, str(at / "out")).collect()] == [("b", 1)]
    # Repeated in another batch; the same id with another question is another request; the failed one is sent again; time moves on.
    put(at / "in", "2", [("a", "one", 4, 0), ("a", "three", 5, None), ("b", "why?", 6, 1), ("d", "four", 180, 0)])
    start(spark, at).awaitTermination()
    want = [("a", "ONE", 0), ("a", "THREE", 0), ("b", "WHY?", 1), ("d", "FOUR", 0)]
    assert answers(spark, at) == want and results.open_requests(spark, str(at / "out")).count() == 0
    # Now older than the watermark: late. The answered one is not asked again, however old its state is.
    put(at / "in", "3", [("e", "late", 10, 0), ("f", "in time", 170, 0), ("d", "four", 175, 7)])
    start(spark, at).awaitTermination()
    assert answers(spark, at) == sorted([*want, ("f", "IN TIME", 0)])
    assert results.stored(spark, str(at / "out")).filter("id = 'd'").count() == 1


def test_killed_between_and_within_batches(spark, at):
    put(at / "in", "1", [("a", "one", 0, 0)])
    start(spark, at).awaitTermination()
    put(at / "in", "2", [("b", "two", 1, 0), ("c", "three", 2, 0)])
    with pytest.raises(StreamingQueryException):
        start(spark, at, dies="c").awaitTermination()
    assert answers(spark, at) == [("a", "ONE", 0)]
    put(at / "in", "3", [("b", "two", 3, 0), ("d", "four", 4, 0)])
    start(spark, at).awaitTermination()
    want = [("a", "ONE", 0), ("b", "TWO", 0), ("c", "THREE", 0), ("d", "FOUR", 0)]
    assert answers(spark, at) == want and results.stored(spark, str(at / "out")).count() == 4
    start(spark, at).awaitTermination()  # nothing new
    assert answers(spark, at) == want


def test_common_subsequence_by_bits():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 90))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert textgen.common_length(a, b) == textgen.common_length(b, a) == row[-1]
