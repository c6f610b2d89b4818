"""Exact top-k search by inner product with an M-tree.

Metric. Every vector x gets one more component, sqrt(M^2 - |x|^2), M the largest norm; a query gets 0. The Euclidean distance
of a query q to a vector x is then sqrt(|q|^2 + M^2 - 2 q.x): nearest is highest inner product.

Tree. A node of more than PAGE vectors gets up to FANOUT of them as centres, each vector goes to the nearest one, and so on level
by level, as joins of shares of bounded size. A routing node is a row with its children's centres, covering radii and distances
to the node's own centre. A node of at most PAGE vectors is a page: one row of leaf nodes, each with centre, covering radius
and distance to the page's centre, and every entry's distance to its leaf's centre.

Search. A query goes down to its nearest page, whose search bounds the distance of its k-th result. With that bound it goes down
again from the root to every page that can hold something nearer: a child is skipped where the stored distance to its parent's
centre and the triangle inequality rule it out, before its own distance is computed, and then by that distance. Each query
visits its pages nearest first, in waves (1, WAVE, WAVE^2, ... pages) between which its bound tightens and pages drop out. A
page is sent to the tasks of the queries that visit it, once for each BLOCK of them. Inside, leaf nodes and entries are skipped by
their stored distances in the same way. Scores are integer inner products, so results are exact; ties go to the smaller id.

Equal vectors are one entry with its k + d smallest ids, d the most vectors of one query's id (no more can be in any result),
and equal queries search once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, table

FANOUT, PAGE, LEAF, BLOCK, CHUNK, SPREAD, WAVE, DEPTH = 32, 2048, 64, 2048, 8192, 64, 4, 24
ROOT = "0"
MOST_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor of scale x component, as array of long; what no long can hold is the nearest long). Vectors null or holding
    null or non-finite components, and rows without an id, take no part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """v, ids: each distinct vector with its `most` smallest ids, in two steps so that a frequent vector is dealt out."""
    once = rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)))
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("v", "deal").orderBy("vec_id"))).filter(F.col("r") <= most)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= most)
    return second.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most `most` each


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Space:
    """The lifted metric over integer vectors of `dim` components (shorter ones are padded with 0), squared norms up to top."""

    def __init__(self, dim: int, top: float):
        self.dim, self.top = dim, float(top)
        # Below 2^53 float products are exact, below 2^62 those of 64-bit integers, else only those of unbounded ones.
        self.kind = np.float64 if top < 1 << 53 else np.int64 if top < (1 << 62) * 0.999 else object

    def lift(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        return np.concatenate([f, np.sqrt(np.maximum(self.top - (f * f).sum(axis=1), 0))[:, None]], axis=1)

    @staticmethod
    def flat(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)

    def slack(self, squares: np.ndarray | Column) -> np.ndarray | Column:
        """More than the rounding of any distance from a query of that squared norm."""
        root = F.sqrt if isinstance(squares, Column) else np.sqrt
        return 1e-6 * root(squares + (self.top + 1))

    def limit(self, squares: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """How far from a query anything may be that reaches the score kth (NaN: none yet)."""
        return np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(squares + self.top - 2 * kth, 0)) + self.slack(squares))

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Row by row inner products as int64; those no long can hold are the nearest long."""
        s = (q.astype(self.kind) * x.astype(self.kind)).sum(axis=1)
        return np.array([max(-MOST_LONG, min(MOST_LONG, v)) for v in s], dtype=np.int64) if self.kind is object else s.astype(np.int64)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))

    @staticmethod
    def some_distances(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the pairs that are open (a by b), the others infinite, and how many were formed for each row of a: those of open
        pairs alone or, where most of the rows and columns with any are open, their whole block."""
        out, formed = np.full(open_.shape, np.inf), np.zeros(len(a), dtype=np.int64)
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if 4 * open_.sum() >= 3 * len(rows) * len(cols):
            if len(rows):
                block = np.ix_(rows, cols)
                out[block] = np.where(open_[block], Space.distances(a[rows], b[cols]), np.inf)
                formed[rows] = len(cols)
            return out, formed
        r, c = np.nonzero(open_)
        for i in range(0, len(r), 65536):
            at, to = r[i : i + 65536], c[i : i + 65536]
            d = a[at] - b[to]
            out[at, to] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out, open_.sum(axis=1)


def build_page(x: np.ndarray, centre: np.ndarray, space: Space, leaf: int | None = None) -> dict[str, np.ndarray]:
    """A page of the rows of x around a lifted centre. order: rows by leaf node; starts: first of each node, and the end; centres:
    lifted; stored: entries' distances to their node's centre; apart: nodes' distances to the page's centre. Nodes' centres are
    spread by farthest-first choice."""
    n = len(x)
    lifted = space.lift(x)
    m = max(1, -(-n // (leaf or LEAF)))
    centres = [0]
    near = Space.distances(lifted, lifted[:1])[:, 0]
    owner = np.zeros(n, dtype=np.int64)
    for k in range(1, m):
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        centres.append(far)
        d = Space.distances(lifted, lifted[far : far + 1])[:, 0]
        closer = d < near
        owner[closer], near[closer] = k, d[closer]
    order = np.lexsort((near, owner))
    at = lifted[centres]
    return {"order": order, "starts": np.searchsorted(owner[order], np.arange(len(centres) + 1)), "centres": at, "stored": near[order], "apart": Space.distances(at, centre[None, :])[:, 0]}


def search_page(q: np.ndarray, to_page: np.ndarray, kth: np.ndarray, page: dict, space: Space, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, entry) of every entry that may be among a query's k best, given its distance to the page's centre and
    the score its k-th result has already (NaN: none), and how many distances and inner products were formed for each query."""
    x, starts, centres, stored, apart = page["x"], page["starts"], page["centres"], page["stored"], page["apart"]
    flat = Space.flat(q)
    squares = (flat * flat).sum(axis=1)
    slack = space.slack(squares)
    kth = kth.astype(np.float64).copy()
    radius = np.array([stored[a:b].max() if b > a else 0.0 for a, b in zip(starts[:-1], starts[1:])])
    limit = space.limit(squares, kth)
    # By the parent's distance first; only nodes it leaves open get a distance of their own.
    open_ = np.abs(to_page[:, None] - apart[None, :]) - radius[None, :] <= (limit + slack)[:, None]
    to_node, cost = Space.some_distances(flat, centres, open_)
    reach = to_node - radius[None, :] - slack[:, None]
    turn = np.argsort(reach, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    rows, scores, entries = [], [], []
    for step in range(len(radius)):
        # Each query's next nearest node; queries that take the same one share the work.
        node = turn[:, step]
        live = np.flatnonzero(reach[np.arange(len(q)), node] <= limit)
        if not len(live):
            break
        for c in np.unique(node[live]):
            mine = live[node[live] == c]
            a, b = starts[c], starts[c + 1]
            r, e = np.nonzero(np.abs(to_node[mine, c][:, None] - stored[None, a:b]) <= (limit[mine] + slack[mine])[:, None])
            if not len(r):
                continue
            some, these = np.unique(r), np.unique(e)
            if space.kind is np.float64 and 4 * len(r) >= 3 * len(some) * len(these):
                cost[mine[some]] += len(these)
                s = (q[mine[some]].astype(np.float64) @ x[a + these].astype(np.float64).T)[np.searchsorted(some, r), np.searchsorted(these, e)].astype(np.int64)
            else:
                np.add.at(cost, mine[r], 1)
                s = np.concatenate([space.products(q[mine[r[i : i + 65536]]], x[a + e[i : i + 65536]]) for i in range(0, len(r), 65536)])
            keep = ~(s < kth[mine[r]])
            r, e, s = r[keep], e[keep], s[keep]
            rows.append(mine[r])
            scores.append(s)
            entries.append(a + e)
            block = np.full((len(mine), b - a), -np.inf)
            block[r, e] = s
            best[mine] = -np.partition(-np.concatenate([best[mine], block], axis=1), k - 1, axis=1)[:, :k]
            floor = np.nextafter(best[mine].min(axis=1), -np.inf)  # a float may be above the long it stands for
            kth[mine] = np.where(np.isinf(floor), kth[mine], np.fmax(kth[mine], floor))
            limit[mine] = space.limit(squares[mine], kth[mine])
    if not rows:
        return *(np.empty(0, np.int64) for _ in range(3)), cost
    r, s, e = np.concatenate(rows), np.concatenate(scores), np.concatenate(entries)
    ok = ~(s < kth[r])
    return r[ok], s[ok], e[ok], cost


def _look_up(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with the columns of small (one row a node), where a node has one. Nodes of very many rows meet in several tasks."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16)).cast("int")).join(salted, ["node", "salt"]).drop("salt")


def _paired(rows: DataFrame, sides: DataFrame, share: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows of one node, that node's row of sides), in shares of about `share` rows. sides is sent once for each share."""
    sizes = rows.groupBy("node").agg((1 + F.floor(F.count(F.lit(1)) / share)).cast("int").alias("shares"))
    dealt = _look_up(rows, sizes).withColumn("part", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int")).drop("shares")
    copies = sides.join(sizes, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    copies = copies.select(*(F.col(c).alias(c) for c in copies.columns))  # columns of its own, where both sides come from one table
    empty = {c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")}

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = work(a, b) if len(a) else None
        return pd.DataFrame(empty) if out is None or out.empty else out

    return dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInPandas(pair, schema)


class Tree:
    """routing: node, names, centres, radii, apart (to the node's centre), ends (whether a child is a page). pages: node, x, starts,
    centres, stored, apart, ids. Both are written tables."""

    def __init__(self, vectors: DataFrame, space: Space):
        self.space = space
        dim = space.dim
        finished, children = [], []
        open_ = vectors.select("v", "ids", F.lit(ROOT).alias("node"), F.lit(0.0).alias("far"), F.lit(None).cast("array<bigint>").alias("own"))
        for depth in range(10_000):
            sizes = materialise(open_.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.first("own").alias("own")), "sizes")
            if depth:
                children.append(sizes)
            big = sizes.filter(F.col("n") > PAGE).select("node", F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / PAGE)).cast("int").alias("fan"))
            if not big.limit(1).count():
                finished.append(open_)
                break
            marked = materialise(_look_up_left(open_, big), "marked")
            finished.append(marked.filter("fan is null").drop("fan"))
            split = marked.filter("fan is not null")
            order = Window.partitionBy("node").orderBy(F.xxhash64("v"), "v")
            chosen = split.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= FANOUT) & (F.col("r") <= F.col("fan")))
            pivots = chosen.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("pivots"))
            by_hash = depth >= DEPTH  # vectors that rounding cannot tell apart

            def assign(rows: pd.DataFrame, side: pd.DataFrame, by_hash: bool = by_hash) -> pd.DataFrame:
                at = [p["v"] for p in side["pivots"].iloc[0]]
                d = Space.distances(space.lift(_matrix(rows["v"], dim)), space.lift(_matrix(at, dim)))
                to = np.array([hash(tuple(v)) for v in rows["v"]]) % len(at) if by_hash else d.argmin(axis=1)
                node = side["node"].iloc[0]
                return pd.DataFrame({"v": rows["v"], "ids": rows["ids"], "node": [f"{node}.{i}" for i in to], "far": d[np.arange(len(d)), to], "own": [at[i] for i in to]})

            open_ = materialise(_paired(split.select("v", "ids", "node"), pivots, CHUNK, assign, "v array<bigint>, ids array<bigint>, node string, far double, own array<bigint>"), "open")
        every = None
        for c in children:
            every = c if every is None else every.unionByName(c)
        self.routing = materialise(self._routing(vectors.sparkSession, every), "routing")
        leaves = finished[0]
        for f in finished[1:]:
            leaves = leaves.unionByName(f)
        self.pages = materialise(self._pages(leaves), "pages")

    def _routing(self, spark: SparkSession, every: DataFrame | None) -> DataFrame:
        schema = "node string, names array<string>, centres binary, radii array<double>, apart array<double>, ends array<boolean>"
        if every is None:
            return spark.createDataFrame([], schema)
        space = self.space
        parent = every.select(F.col("node").alias("up"), F.col("own").alias("centre"))
        named = every.select(F.substring_index("node", ".", -1).alias("last"), F.col("node").alias("name"), "n", "radius", "own").withColumn("up", F.expr("substr(name, 1, length(name) - length(last) - 1)")).join(parent, "up", "left")

        def pack(b: pd.DataFrame) -> pd.DataFrame:
            at = space.lift(_matrix(b["own"], space.dim))
            own = b["centre"].iloc[0]
            apart = np.full(len(b), np.nan) if own is None else Space.distances(at, space.lift(_matrix([own], space.dim)))[:, 0]
            return pd.DataFrame({"node": [b["up"].iloc[0]], "names": [b["name"].tolist()], "centres": [at.tobytes()], "radii": [b["radius"].tolist()], "apart": [apart.tolist()], "ends": [(b["n"] <= PAGE).tolist()]})

        return named.groupBy("up").applyInPandas(pack, schema)

    def _pages(self, leaves: DataFrame) -> DataFrame:
        space = self.space

        def build(b: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(b["v"], space.dim)
            own = b["own"].iloc[0]
            p = build_page(x, space.lift(x[:1] if own is None else _matrix([own], space.dim))[0], space)
            return pd.DataFrame({"node": [b["node"].iloc[0]], "x": [x[p["order"]].astype("<i8").tobytes()], "starts": [p["starts"].tolist()], "centres": [p["centres"].tobytes()], "stored": [p["stored"].tolist()], "apart": [p["apart"].tolist()], "ids": [[list(map(int, b["ids"].iloc[i])) for i in p["order"]]], "root": [None if own is not None else space.lift(x[:1]).tobytes()]})

        return leaves.groupBy("node").applyInPandas(build, "node string, x binary, starts array<bigint>, centres binary, stored array<double>, apart array<double>, ids array<array<bigint>>, root binary")


def _look_up_left(rows: DataFrame, small: DataFrame) -> DataFrame:
    """As _look_up, with null where a node has no row in small."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16)).cast("int")).join(salted, ["node", "salt"], "left").drop("salt")


ASK = "v array<bigint>, node string, to double, reach double, ends boolean"


def _children(tree: Tree, asks: DataFrame, nearest: bool) -> DataFrame:
    """v, node, to (distance to its centre), reach, ends, of each ask's children: the nearest one, or all within its bound (column kth).
    asks: v, node, to, kth. cost counts the distances formed."""
    space = tree.space

    def work(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        q = Space.flat(_matrix(rows["v"], space.dim))
        squares = (q * q).sum(axis=1)
        slack, limit = space.slack(squares), space.limit(squares, rows["kth"].to_numpy(dtype=np.float64))
        s = side.iloc[0]
        radii, apart, names, ends = np.array(s["radii"]), np.array(s["apart"], dtype=np.float64), s["names"], s["ends"]
        to = rows["to"].to_numpy(dtype=np.float64)
        centres = np.frombuffer(s["centres"]).reshape(-1, space.dim + 1)
        gap = np.abs(to[:, None] - apart[None, :])  # NaN (the root has no centre) rules nothing out
        if nearest:
            # The child whose stored distance is most like the query's own is measured first; the others only where they can be nearer.
            every = np.arange(len(q))
            guess = np.where(np.isnan(gap), 0.0, gap).argmin(axis=1)
            first = np.zeros(gap.shape, dtype=bool)
            first[every, guess] = True
            d, formed = Space.some_distances(q, centres, first)
            more, again = Space.some_distances(q, centres, ~(gap > (d[every, guess] + slack)[:, None]) & ~first)
            d, formed = np.minimum(d, more), formed + again
            r, c = every, d.argmin(axis=1)
            reach = d - radii[None, :] - slack[:, None]
        else:
            d, formed = Space.some_distances(q, centres, ~(gap - radii[None, :] > (limit + slack)[:, None]))
            reach = d - radii[None, :] - slack[:, None]
            r, c = np.nonzero(np.isfinite(d) & (reach <= limit[:, None]))
        out = pd.DataFrame({"v": rows["v"].to_numpy()[r], "node": [names[i] for i in c], "to": d[r, c], "reach": reach[r, c], "ends": [bool(ends[i]) for i in c], "cost": 0})
        out["cost"] = np.where(np.concatenate([[True], np.diff(r) > 0]) if len(r) else [], formed[r], 0)
        return out

    return _paired(asks, tree.routing, BLOCK, work, ASK + ", cost long")


def _visit(tree: Tree, asks: DataFrame, most: int) -> DataFrame:
    """v, hits (minus score and id, best first, at most `most`), cost: what each ask's page adds. asks: v, node, to, kth."""
    space = tree.space

    def work(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        s = side.iloc[0]
        page = {"x": np.frombuffer(s["x"], "<i8").reshape(-1, space.dim), "starts": np.array(s["starts"]), "centres": np.frombuffer(s["centres"]).reshape(-1, space.dim + 1), "stored": np.array(s["stored"]), "apart": np.array(s["apart"])}
        q = _matrix(rows["v"], space.dim)
        to = rows["to"].to_numpy(dtype=np.float64)
        if s["root"] is not None:
            to = Space.distances(Space.flat(q), np.frombuffer(s["root"]).reshape(1, -1))[:, 0]
        r, score, e, cost = search_page(q, to, rows["kth"].to_numpy(dtype=np.float64), page, space, most)
        order = np.lexsort((-score, r))
        cuts = np.searchsorted(r[order], np.arange(len(q) + 1))
        hits = []
        for i in range(len(q)):
            one = order[cuts[i] : cuts[i + 1]]
            hits.append([{"minus": m, "id": x} for m, x in sorted((-int(score[j]), int(x)) for j in one for x in s["ids"][e[j]])[:most]])
        return pd.DataFrame({"v": rows["v"], "hits": hits, "cost": cost})

    return _paired(asks, tree.pages, BLOCK, work, "v array<bigint>, hits array<struct<minus:bigint,id:bigint>>, cost long")


def search(tree: Tree, asked: DataFrame, most: int) -> DataFrame:
    """v, hits (minus score and id, best first, at most `most`), cost (distances and inner products) for distinct asked v."""
    space = tree.space
    start = asked.select("v", F.lit(ROOT).alias("node"), F.lit(float("nan")).alias("to"), F.lit(float("nan")).alias("kth"))
    lone = not tree.routing.limit(1).count()
    costs = []
    # Down to the nearest page.
    at = start.withColumn("ends", F.lit(lone))
    done = [at.filter("ends")]
    while not lone:
        step = materialise(_children(tree, at.select("v", "node", "to", "kth"), True), "near")
        costs.append(step.select("v", "cost"))
        step = step.withColumn("kth", F.lit(float("nan")))
        done.append(step.filter("ends").select(*at.columns))
        at = step.filter("not ends").select(*at.columns)
        if not at.limit(1).count():
            break
    homes = done[0]
    for d in done[1:]:
        homes = homes.unionByName(d)
    best = materialise(_visit(tree, homes.select("v", "node", "to", "kth"), most), "best")
    costs.append(best.select("v", "cost"))
    if not lone:
        bounded = lambda hits: F.when(F.size(hits) >= most, -F.element_at(hits, F.lit(most))["minus"].cast("double")).otherwise(F.lit(float("nan")))
        squares = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
        home = homes.select("v", F.col("node").alias("home"))
        # Down again, to all pages the bound leaves open.
        at = start.drop("kth").join(best.select("v", bounded(F.col("hits")).alias("kth")), "v")
        pages = []
        while True:
            step = materialise(_children(tree, at.select("v", "node", "to", "kth"), False), "open")
            costs.append(step.select("v", "cost"))
            pages.append(step.filter("ends").select("v", "node", "to", "reach"))
            if not step.filter("not ends").limit(1).count():
                break
            at = step.filter("not ends").select("v", "node", "to").join(best.select("v", bounded(F.col("hits")).alias("kth")), "v")
        todo = pages[0]
        for p in pages[1:]:
            todo = todo.unionByName(p)
        todo = todo.join(home, "v").filter("node <> home").drop("home")
        wave = 1
        while True:
            kth = best.select("v", bounded(F.col("hits")).alias("kth"))
            limit = F.when(F.isnan("kth"), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(squares + space.top - 2 * F.col("kth"), F.lit(0.0))) + space.slack(squares))
            live = todo.join(kth, "v").filter(F.col("reach") <= limit)
            live = materialise(live.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("reach", "node"))), "wave")
            if not live.limit(1).count():
                break
            seen = _visit(tree, live.filter(F.col("turn") <= wave).select("v", "node", "to", "kth"), most)
            both = best.select("v", "hits", F.lit(0).cast("long").alias("cost")).unionByName(seen)
            merged = both.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, most).alias("hits"), F.sum("cost").alias("cost"))  # `most` for each page of the wave
            best = materialise(merged, "best")
            costs.append(best.select("v", "cost"))
            todo = live.filter(F.col("turn") > wave).drop("turn", "kth")
            wave *= WAVE
    total = costs[0]
    for c in costs[1:]:
        total = total.unionByName(c)
    return best.select("v", "hits").join(total.groupBy("v").agg(F.sum("cost").alias("cost")), "v")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with rows of other ids.

    rows, queries: vec_id, v (array of long). All results if there are fewer than k; rows that repeat an id and vector count
    once; every row with the query's id is its own. A score that no long can hold is the nearest long, and ranks as such. No rows
    or no queries give an empty table.
    """
    spark = rows.sparkSession
    asked = queries.select("vec_id", "v").distinct()
    # A list has room for all rows of the query's own id: as many as that id has vectors.
    own_rows = rows.select("vec_id", "v").distinct().join(asked.select("vec_id").distinct(), "vec_id").groupBy("vec_id").count()
    most = k + max(1, own_rows.agg(F.max("count")).first()[0] or 0)
    found = materialise(distinct_vectors(rows, most), "vectors")
    squares = F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    n, dim, top = found.agg(F.count(F.lit(1)), F.max(F.size("v")), squares).first()
    q_dim, q_top = asked.agg(F.max(F.size("v")), squares).first()
    if not n or q_top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tree = Tree(found, Space(max(dim, q_dim, 1), max(top, q_top, 1.0)))
    discard(found)
    lists = search(tree, asked.select("v").distinct(), most)
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists, "v")
    picked = own.select("query_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k).alias("best"))
    return picked.select("query_id", F.posexplode("best").alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.minus")).alias("score"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))
