"""Best-fit packing of documents into sequences of a fixed number of tokens (best-two-fit).

The packing depends only on how many pieces there are of each length, so it is planned on that histogram: at most
`capacity` counts, whatever the size of the corpus. A bin is filled greedily with the longest piece that fits; then, if it
holds several, its smallest piece is replaced by two unpacked pieces if together they fit the expanded gap more tightly. Only
a piece of at most a third of the capacity makes way: two for a larger one would use up pieces that later bins need. A bin so
made is a pattern; it is repeated while the counts last, and each round uses up at least one length, so there are few patterns.
Pieces then find their places by rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import crc
from .common import materialise, sliced, table
from .tokens import default_ranks, ids_of

CAPACITY = 2048
#: Pieces of one length are dealt out for ranking in shares of about LEAST_SHARE, in all MOST_SHARES beside one a length.
LEAST_SHARE, MOST_SHARES = 256, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first one of a long document may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def pieces_of(docs: DataFrame, ranks: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece. Null text is empty: the document is then its end id alone. Repeated rows give repeated pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        for b in sliced(batches):
            own, rows = [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                ids = np.concatenate([ids_of(text, ranks), end])
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    own.append(i)
                    rows.append((k, s, n, crc(ids[s : s + n].tobytes())))
            k, s, n, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, c))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return slim.mapInArrow(run, PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) for counts of pieces by length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []

    def longest(most: int) -> int:
        found = np.flatnonzero(left[: most + 1])
        return int(found[-1]) if len(found) and found[-1] > 0 else 0

    while n := longest(capacity):
        members, room = [], capacity
        while room and (n := longest(min(room, capacity))):
            members.append(n)
            left[n] -= 1
            room -= n
        # Best-two-fit: the smallest member makes way for two pieces that leave a smaller gap.
        while room and len(members) > 1 and 3 * members[-1] <= capacity:
            small = members[-1]
            wide = room + small
            have = np.flatnonzero(left[: wide + 1])
            have = have[have > 0]
            if not len(have):
                break
            mate = np.searchsorted(have, wide - have, side="right") - 1
            ok = mate >= 0
            one, two = have[ok], have[mate[ok]]
            same = (one == two) & (left[one] < 2)
            below = mate[ok] - 1
            two = np.where(same, np.where(below >= 0, have[below], 0), two)
            total = np.where(two > 0, one + two, 0)
            best = int(np.argmax(total)) if len(total) else 0
            if not len(total) or total[best] <= small:
                break
            members.pop()
            left[small] += 1
            pair = sorted((int(one[best]), int(two[best])), reverse=True)
            for n in pair:
                left[n] -= 1
            members = sorted(members + pair, reverse=True)
            room = wide - int(total[best])
        kinds, uses = np.unique(members, return_counts=True)
        more = int((left[kinds] // uses).min())
        left[kinds] -= more * uses
        plan.append((tuple(members), 1 + more))
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of runs, and each run's first sequence, pieces of this length in a sequence, and offsets."""
    runs: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    first = 0
    for members, bins in plan:
        starts: dict[int, list[int]] = {}
        at = 0
        for n in members:
            starts.setdefault(n, []).append(at)
            at += n
        for n, offsets in starts.items():
            runs.setdefault(n, []).append((first, bins, np.array(offsets)))
        first += bins
    out = {}
    for n, found in runs.items():
        each = np.array([bins * len(o) for _, bins, o in found])
        out[n] = (np.concatenate([[0], np.cumsum(each)[:-1]]), np.array([f for f, _, _ in found]), [o for _, _, o in found])
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES; read three times, so pass a written table).

    Every row is placed once. Ties (equal lengths) are ranked by document, piece and checksum, so the result does not depend
    on how rows are dealt out; fully equal rows are interchangeable. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = spark.sparkContext.broadcast(places(plan_packing(counts, capacity)))
    share = max(LEAST_SHARE, sum(counts.values()) // MOST_SHARES)
    shares = F.split(F.lit(",".join(str(1 + counts.get(n, 0) // share) for n in range(capacity + 1))), ",").cast("array<long>")  # constant: folded once
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(shares, F.col("length").cast("int"))).cast("int"))
    histogram = dealt.groupBy("length", "deal").count()  # a row for each share
    before = histogram.select("length", "deal", (F.sum("count").over(Window.partitionBy("length").orderBy("deal")) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(before, ["length", "deal"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                starts, first, offsets = at[int(n)]
                rank = ranks[rows]
                k = np.searchsorted(starts, rank, side="right") - 1
                width = np.array([len(o) for o in offsets])[k]
                seq[rows] = first[k] + (rank - starts[k]) // width
                off[rows] = [offsets[j][r] for j, r in zip(k, (rank - starts[k]) % width)]
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    return pack(materialise(pieces_of(docs, ranks, capacity, end_id), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_ranks())
