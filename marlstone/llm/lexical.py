"""Ranked lexical search, exact, with dual-sorted inverted lists in wavelet trees.

Score. A document that holds a term tf times has the impact (10^9 tf) div (1000 tf + 8 m) for it, m its length norm; the term
adds its weight times that. The impact does not depend on the weight, so lists are ordered without document frequencies.

Index. Each task makes shards of its own documents, without an exchange. A shard's lists, each with the highest impact first,
stand one after another; this sequence of document numbers is a wavelet tree, level by level (each level one bit map, zeros of the
whole level before ones). A node is a range of document numbers, what a list has there is a range of positions, and since partitions
keep the order, the first position has the list's highest impact within the node. So a list is sorted by impact and by document at once. Numbers
follow doc_id. Stored are the bit maps, the impacts of the first level and the sorted terms; counts for rank queries and the other levels' impacts
come from the bit maps when a shard is read.

Search. A node's bound for a query is the sum, over the terms, of weight times first impact. The open nodes of many queries stand in one
table; the best of each query are expanded together (rank queries give the children's ranges of every list), those below the query's
k-th score drop out, and a node of one document is a result: its bound is its score. The k-th score is carried from shard to
shard of a task. Document frequencies are the lengths of the lists, summed over the shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, sliced, table

#: A shard ends with the document that reaches one of these numbers.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 14
#: Queries searched in one pass over the index, queries expanded together, open nodes expanded of each at once, cells of one expansion.
QUERIES, GROUP, WAVE, CELLS = 2000, 64, 16, 1 << 20
#: Bytes of terms (A-Z lower-cased), all others blank.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
SHARD = "doc_ids array<long>, terms binary, starts binary, first binary, bits binary, zeros array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _text() -> F.Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("t")


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, L: documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in sliced(batches, 200):
            for x in b.column("t"):
                inside = np.frombuffer(b" " + x.as_py().translate(TERM_BYTES), dtype=np.uint8) != 0x20
                c = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                n, total = n + (c > 0), total + c
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    row = docs.select(_text()).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build_shard(doc_ids: list[int | None], lengths: list[int], sizes: list[int], terms: list[bytes], counts: list[int], n: int, total: int) -> dict:
    """A shard of documents with their numbers of terms (lengths), of distinct terms (sizes), and these one document after another."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    norm = np.array([25 + (75 * x * n) // total for x in lengths], dtype=np.int64)
    vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
    own = np.repeat(np.arange(len(sizes)), sizes)
    tf = np.array(counts, dtype=np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[own])
    impact[np.array([d is None for d in doc_ids])[own]] = 0  # counted, never found
    # One integer sorts lists, impacts downwards (20 bits), and documents.
    depth = max(1, (len(order) - 1).bit_length())
    key = np.fromiter(map(vocabulary.__getitem__, terms), dtype=np.int64, count=len(terms))
    key = np.sort((key << (20 + depth)) | (((1 << 20) - 1 - impact) << depth) | number[own])
    starts = np.searchsorted(key >> (20 + depth), np.arange(len(vocabulary) + 1)).astype("<i4")
    at, bits, zeros = (key & ((1 << depth) - 1)).astype(np.int32), [], []
    for level in reversed(range(depth)):
        one = (at >> level) & 1 == 1
        bits.append(np.packbits(one))
        at = np.concatenate([at[~one], at[one]])
        zeros.append(int(len(one) - one.sum()))
    first = ((1 << 20) - 1 - ((key >> depth) & ((1 << 20) - 1))).astype("<i4")
    return {"doc_ids": [doc_ids[i] for i in order], "terms": b" ".join(vocabulary), "starts": starts.tobytes(), "first": first.tobytes(), "bits": np.concatenate(bits).tobytes(), "zeros": zeros}


def build_index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int, int]:
    """The shards of docs (doc_id, text), as a table written to the shared folder, with N and L. Whole texts of all rows are indexed.

    A document of more distinct terms than a shard has postings is a shard of its own. Null texts and texts without terms
    are in no shard. Rows without a doc_id count in the statistics but are never found.
    """
    spark = docs.sparkSession
    n, total = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, sizes, terms, counts = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            s = build_shard(ids, lengths, sizes, terms, counts, n, total)
            out = pa.RecordBatch.from_arrays([pa.array([s["doc_ids"]], pa.list_(pa.int64())), *(pa.array([s[k]], pa.binary()) for k in ("terms", "starts", "first", "bits")), pa.array([s["zeros"]], pa.list_(pa.int32()))], names=[f.split()[0] for f in SHARD.split(", ")])
            for x in (ids, lengths, sizes, terms, counts):
                x.clear()
            return out

        for b in sliced(batches, 200):
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("t")):
                found = Counter(terms_of(x.as_py()))
                if not found:
                    continue
                if ids and len(terms) + len(found) > shard_postings:
                    yield flush()
                ids.append(d)
                lengths.append(sum(found.values()))
                sizes.append(len(found))
                terms.extend(found)
                counts.extend(found.values())
                if len(ids) >= shard_docs:
                    yield flush()
        if ids:
            yield flush()

    path = scratch(spark, "lexical")
    shards = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(run, SHARD)
    # Shards are a few MB each: small row groups keep readers' batches small.
    shards.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).option("parquet.block.size.row.check.min", "2").parquet(path)
    return spark.read.schema(SHARD).parquet(path), n, total


class Shard:
    """A read shard. rank: ones before each position, by level; impact: by level, the leaves' last; both with one column more."""

    def __init__(self, row: dict):
        self.doc_ids, self.zeros = row["doc_ids"], np.array(row["zeros"], dtype=np.int32)
        self.terms = row["terms"].split(b" ")
        self.starts, first = np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["first"], "<i4")
        n, depth = len(first), len(self.zeros)
        width = -(-n // 8)
        self.width, self.depth = n + 1, depth
        self.rank = np.zeros((depth, n + 1), dtype=np.int32)
        self.impact = np.zeros((depth + 1, n + 1), dtype=np.int32)
        self.impact[0, :n] = first
        for k in range(depth):
            one = np.unpackbits(np.frombuffer(row["bits"], np.uint8, width, k * width), count=n).view(bool)
            np.cumsum(one, out=self.rank[k, 1:])
            above, z = self.impact[k, :n], self.zeros[k]
            self.impact[k + 1, :z], self.impact[k + 1, z:n] = above[~one], above[one]

    def range_of(self, term: bytes) -> tuple[int, int]:
        """Positions of a term's list in the first level; empty where the shard does not hold it."""
        i = bisect_left(self.terms, term)
        return (int(self.starts[i]), int(self.starts[i + 1])) if i < len(self.terms) and self.terms[i] == term else (0, 0)


def search_shard(shard: Shard, lists: list[dict[bytes, int]], floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, score and document number of what may be among each query's k best, and how many nodes were opened.

    lists: each query's terms with their weights (times repeats). floors: the k-th score each has already (0: none); what is
    below is left out, equal scores are not.
    """
    held = [[(*r, w) for t, w in q.items() if w > 0 and (r := shard.range_of(t))[0] < r[1]] for q in lists]
    wide = max(map(len, held), default=0)
    if not wide:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, 0
    weight = np.zeros((len(lists), wide), dtype=np.int64)
    left, right = np.zeros((len(lists), wide), dtype=np.int32), np.zeros((len(lists), wide), dtype=np.int32)
    for i, q in enumerate(held):
        for j, (a, b, w) in enumerate(q):
            left[i, j], right[i, j], weight[i, j] = a, b, w
    rank, impact, width, depth = shard.rank.ravel(), shard.impact.ravel(), shard.width, shard.depth
    best = np.zeros((len(lists), k), dtype=np.int64)
    floors = floors.copy()
    bound = (np.where(right > left, impact[left], 0) * weight).sum(axis=1)
    query, level, node = np.arange(len(lists)), np.zeros(len(lists), dtype=np.int64), np.zeros(len(lists), dtype=np.int64)
    live = (bound > 0) & (bound >= floors)
    query, level, node, bound, left, right = (x[live] for x in (query, level, node, bound, left, right))
    found, opened = [], 0
    while len(query):
        # The best open nodes of each query.
        order = np.lexsort((-level, -bound, query))
        turn = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        mine = np.zeros(len(order), dtype=bool)
        mine[order[turn < max(1, min(WAVE, CELLS // (wide * len(lists))))]] = True
        q, lv, nd, lo, hi = query[mine], level[mine], node[mine], left[mine], right[mine]
        opened += len(q)
        row = (lv * width)[:, None]
        ones_lo, ones_hi = rank[row + lo], rank[row + hi]
        z = shard.zeros[lv][:, None]
        lo, hi = np.concatenate([lo - ones_lo, z + ones_lo]), np.concatenate([hi - ones_hi, z + ones_hi])
        q, lv, nd = np.concatenate([q, q]), np.concatenate([lv, lv]) + 1, np.concatenate([2 * nd, 2 * nd + 1])
        b = (np.where(hi > lo, impact[(lv * width)[:, None] + lo], 0) * weight[q]).sum(axis=1)
        ok = (b > 0) & (b >= floors[q])
        q, lv, nd, b, lo, hi = q[ok], lv[ok], nd[ok], b[ok], lo[ok], hi[ok]
        leaf = lv == depth
        if leaf.any():
            found.append((q[leaf], b[leaf], nd[leaf]))
            by = np.lexsort((-b[leaf], q[leaf]))
            fq, fb = q[leaf][by], b[leaf][by]
            place = np.arange(len(fq)) - np.searchsorted(fq, fq)
            top = place < k
            new = np.zeros_like(best)
            new[fq[top], place[top]] = fb[top]
            best = -np.sort(-np.concatenate([best, new], axis=1), axis=1)[:, :k]
            floors = np.maximum(floors, best[:, -1])
        rest, inner = ~mine & (bound >= floors[query]), ~leaf & (b >= floors[q])
        query, level, node, bound = (np.concatenate([x[rest], y[inner]]) for x, y in ((query, q), (level, lv), (node, nd), (bound, b)))
        left, right = np.concatenate([left[rest], lo[inner]]), np.concatenate([right[rest], hi[inner]])
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, opened
    q, s, d = (np.concatenate(x) for x in zip(*found))
    ok = s >= floors[q]
    return q[ok], s[ok], d[ok], opened


def _frequencies(index: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """Documents holding each of the asked terms; collected: a row for each of them."""
    wanted = index.sparkSession.sparkContext.broadcast(sorted(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            for terms, starts in zip(b.column("terms"), b.column("starts")):
                place = {t: i for i, t in enumerate(terms.as_py().split(b" "))}
                lengths = np.diff(np.frombuffer(starts.as_py(), "<i4"))
                for t in wanted.value:
                    i = place.get(t)
                    if i is not None:
                        sums[t] += int(lengths[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["term", "df"])

    rows = index.select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in rows.collect()}


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_block(index: DataFrame, n: int, items: list, k: int) -> DataFrame:
    """item_id, doc_id, score: k rows an item and task at most. items: (item_id, terms with repeats)."""
    asked = set().union(*(c for _, c in items)) if items else set()
    df = _frequencies(index, asked)
    weights = {t: weight_of(n, x) for t, x in df.items()}
    # Queries of like numbers of terms are expanded together.
    packed = sorted(((i, {t: c * weights[t] for t, c in terms.items() if t in weights}) for i, terms in items), key=lambda x: (len(x[1]), x[0]))
    shared = index.sparkSession.sparkContext.broadcast(packed)  # QUERIES items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        lists: list[list[tuple[int, int]]] = [[] for _ in queries]  # (minus score, doc_id) of each query's best yet
        for b in sliced(batches, 1):
            shard = Shard({c: b.column(c)[0].as_py() for c in b.schema.names})
            for at in range(0, len(queries), GROUP):
                group = queries[at : at + GROUP]
                floors = np.array([-lists[at + i][-1][0] if len(lists[at + i]) == k else 0 for i in range(len(group))], dtype=np.int64)
                q, s, d, _ = search_shard(shard, [x for _, x in group], floors, k)
                order = np.lexsort((d, -s, q))
                q, s, d = q[order], s[order], d[order]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                for i, score, doc in zip(q[top].tolist(), s[top].tolist(), d[top].tolist()):
                    lists[at + i].append((-score, shard.doc_ids[doc]))
                for i in np.unique(q).tolist():
                    lists[at + i] = sorted(lists[at + i])[:k]
        rows = [(queries[i][0], doc, -minus) for i, best in enumerate(lists) for minus, doc in best]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, n: int, items: DataFrame, k: int = 10, most_queries: int = QUERIES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0, equal scores by doc_id.

    items: item_id, text. They are searched in blocks of about most_queries, each one pass over the index. Items without an id take
    no part, without terms have no result; the terms of rows that repeat an item_id count together, equal rows once.
    """
    spark = index.sparkSession
    asked = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), _text()).distinct()
    blocks = 1 + asked.count() // most_queries
    out = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about most_queries rows
        terms: dict[int, Counter] = {}
        for r in mine:
            terms.setdefault(r["item_id"], Counter()).update(terms_of(bytes(r["t"])))
        if n and terms:
            part = _search_block(index, n, sorted(terms.items()), k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")  # k rows for each task that searched
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n, _ = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, n, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM n), m AS (SELECT doc_id, 25 + (75 * n * n_docs) // total AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM a JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
