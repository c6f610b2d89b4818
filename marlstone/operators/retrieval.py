"""Lexical, dense and fused retrieval, diversity, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import written

K1, B, RRF_K = 1.5, 0.75, 60


#: Pairs of query and token up to which queries are sent to every task; beyond that they are joined.
MOST_ASKED = 500_000
#: Cells of the table of tokens and queries up to which it is sent to every task (64 MB).
MOST_WORTH = 8_000_000
#: Documents counted in one go, and tokens up to which further documents join them: tokens are held several times over.
LOT, LOT_TOKENS = 256, 1 << 18


def postings(docs: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """id, token, tf, dl: one row for each document and token."""
    d = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return d.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(post: DataFrame, queries: DataFrame, n_docs: DataFrame) -> DataFrame:
    """query, id, score of documents that share a token with the query. queries: query, token (distinct); n_docs: one row n,
    avgdl over all documents, empty ones included."""
    asked = post.join(queries.select("token").distinct(), "token", "left_semi")
    terms = queries.join(asked.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    hits = asked.join(terms, "token").join(F.broadcast(n_docs))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query", "id").agg(F.sum(part).alias("score"))


def lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most LOT documents and LOT_TOKENS tokens; a longer document is a slice of its own."""
    total = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        end = min(at + LOT, max(at + 1, int(np.searchsorted(total, total[at] + LOT_TOKENS, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def lexical(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, rank, id, score of each query's k best documents by BM25. docs: id, t (array of tokens); queries: query, token
    (distinct).

    One pass over the corpus keeps a document's length and its counts of asked tokens, a row a document, and writes them; what a
    token is worth comes from those rows. Then each task scores its documents against all queries and passes on only its
    k best of each. More than MOST_ASKED pairs of query and token are joined instead.
    """
    pairs = queries.limit(MOST_ASKED + 1).toPandas()
    if len(pairs) > MOST_ASKED:
        post = postings(docs, F.col("t"), "id")
        return top_k(bm25(post, queries, docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("avgdl"))), k)
    if pairs.empty:
        return docs.sparkSession.createDataFrame([], f"query long, rank long, id {dict(docs.dtypes)['id']}, score double")
    words, term = np.unique(pairs["token"].to_numpy(dtype=object), return_inverse=True)
    asked, query = np.unique(pairs["query"].to_numpy(), return_inverse=True)
    vocabulary = pa.array(words.tolist(), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (lot for whole in batches for lot in lots(whole)):
            lists = b.column("t")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[known] * len(words) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(key // len(words), minlength=len(sizes)))).astype(np.int32)
            column = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes.astype(np.int32)), column(key % len(words)), column(tf)], names=["id", "dl", "terms", "tf"])

    id_type = dict(docs.dtypes)["id"]
    counted = written(docs.select("id", "t").mapInArrow(count, f"id {id_type}, dl int, terms array<int>, tf array<int>"), "counted")
    n, mean = counted.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = np.zeros(len(words))
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each asked token
        df[r["term"]] = r["count"]
    worth = np.zeros((len(words), len(asked)))
    worth[term, query] = np.log(1 + ((n or 0) - df[term] + 0.5) / (df[term] + 0.5)) * (K1 + 1)
    shared = docs.sparkSession.sparkContext.broadcast((asked, worth)) if worth.size <= MOST_WORTH else None
    if shared is None:
        rows = counted.select("id", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("id", "dl", "x.*")
        return top_k(_joined(rows, pairs.assign(term=term), df, n, mean), k)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, value = shared.value
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            lists = b.column("terms")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tf = b.column("tf").flatten().to_numpy().astype(np.float64)
            dl = b.column("dl").to_numpy()[doc]
            x = np.zeros((len(sizes), len(value)))
            x[doc, lists.flatten().to_numpy()] = tf / (tf + K1 * (1 - B + B * dl / mean))
            s = x @ value
            # All that reach the k-th score (to 9 places, as ranks go); at most a batch.
            rounded = np.round(s, 9)
            bar = np.partition(rounded, -k, axis=0)[-k] if len(s) > k else np.zeros(s.shape[1])
            d, q = np.nonzero((rounded >= bar) & (s > 0))
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), b.column("id").take(pa.array(d)), pa.array(s[d, q])], names=["query", "id", "score"])

    return top_k(counted.mapInArrow(score, f"query {dict(queries.dtypes)['query']}, id {id_type}, score double"), k)


def _joined(rows: DataFrame, pairs: pd.DataFrame, df: np.ndarray, n: int, mean: float) -> DataFrame:
    """query, id, score by a join of counted terms with the pairs of query and term."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1)
    terms = rows.sparkSession.createDataFrame(pd.DataFrame({"query": pairs["query"], "term": pairs["term"].astype("int32"), "worth": idf[pairs["term"]]}))
    part = F.col("worth") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return rows.withColumnRenamed("terms", "term").join(terms, "term").groupBy("query", "id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """query, rank, id, score: ties (to 9 places) by id."""
    w = Window.partitionBy("query").orderBy(F.round(score, 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "id", score)


def fill_zero(top: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """top with documents of score 0 in id order appended where a query has fewer than k scored ones. Only the first 2k ids can
    be needed, so nothing like queries x documents is built."""
    have = queries.select("query").distinct().join(top.groupBy("query").agg(F.count(F.lit(1)).alias("c")), "query", "left").select("query", F.coalesce("c", F.lit(0)).alias("c")).filter(F.col("c") < k)
    first = docs.select("id").orderBy("id").limit(2 * k)
    zero = have.join(F.broadcast(first)).join(top.select("query", "id"), ["query", "id"], "left_anti")  # 2k rows
    w = Window.partitionBy("query").orderBy("id")
    more = zero.withColumn("r", F.row_number().over(w)).filter(F.col("c") + F.col("r") <= k).select("query", (F.col("c") + F.col("r")).cast("long").alias("rank"), "id", F.lit(0.0).alias("score"))
    return top.unionByName(more)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Dense queries sent to every task at a time.
MOST_QUERIES = 2000


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, rank, id, score by inner product. vectors: id, v; queries: query, q. Queries go to the vectors in blocks of about
    MOST_QUERIES, so none moves; each task keeps its best k for each query before the exchange."""
    blocks = -(-queries.count() // MOST_QUERIES)
    best = None
    for b in range(max(blocks, 1)):
        some = queries if blocks <= 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        scored = top_k(vectors.join(F.broadcast(some)).select("query", "id", F.round(dot("v", "q"), 9).alias("score")), k)
        best = scored if best is None else best.unionByName(scored)
    return best


def rrf(a: DataFrame, b: DataFrame, depth: int = 100, k: int = RRF_K) -> DataFrame:
    """query, id, score, rank_a, rank_b: reciprocal rank fusion; a ranker that misses a document adds nothing."""
    x = a.filter(F.col("rank") <= depth).select("query", "id", F.col("rank").alias("rank_a"))
    y = b.filter(F.col("rank") <= depth).select("query", "id", F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return x.join(y, ["query", "id"], "full").select("query", "id", (part("rank_a") + part("rank_b")).alias("score"), "rank_a", "rank_b")


def mmr(pool: DataFrame, lam: float, k: int) -> DataFrame:
    """query, rank, id: maximal marginal relevance over each query's pool (query, id, rank, score, v; a few dozen rows).
    Relevance is min-max scaled in the pool; ties keep the original order."""

    def pick(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank", kind="stable")
        v, rel = np.stack([np.asarray(x, dtype=np.float64) for x in b["v"]]), b["score"].to_numpy(dtype=np.float64)
        width = rel.max() - rel.min()
        rel = (rel - rel.min()) / width if width > 0 else np.zeros(len(rel))
        sim = v @ v.T
        free, nearest, out = np.ones(len(rel), dtype=bool), np.full(len(rel), -np.inf), []
        while free.any() and len(out) < k:
            value = rel if not out else lam * rel - (1 - lam) * nearest
            at = int(np.argmax(np.where(free, value, -np.inf)))
            out.append(at)
            free[at] = False
            nearest = np.maximum(nearest, sim[at])
        return pd.DataFrame({"query": b["query"].iloc[0], "rank": np.arange(1, len(out) + 1), "id": b["id"].to_numpy()[out]})

    return pool.groupBy("query").applyInPandas(pick, "query long, rank long, id long")


def jaccard(a: str, b: str) -> Column:
    """Of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def ndcg(ranked: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """query, ndcg. ranked: query, rank, gain; ideal: query, gain, n (how many documents of the whole corpus have this gain).
    Null where the ideal is 0."""
    got = ranked.filter(F.col("rank") <= k).groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    before = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("gain"))) - F.col("n")
    best = ideal.withColumn("from", before).filter(F.col("from") < k).withColumn("r", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + F.col("n"), F.lit(k)))))
    best = best.groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("idcg"))
    return best.join(got, "query", "left").select("query", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))
