"""Filter audit, quality network and ranked search against plain versions, with awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("marlstone.llm")
import corpus_pipeline
from marlstone.llm import audit, language, lexical, quality, registry, toxicity

SOURCE = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not Path(SOURCE).exists(), reason="no test data")
LONG = " ".join(f"w{i}" for i in range(400))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (None, LONG, "b"), (None, LONG, None), (4, None, ""), (5, "", None), (6, "#" + LONG, "b"), (7, "AB " * 300, "b"),
    (8, "é x y " * 210, "a"), (9, "one\x0btwo\x1cthree", "c"), (10, "Z" * 3 + "ü" * 97, "c"), (-1, LONG.upper(), "c"), (11, "x" * 200_000, "a"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (7, 0, 1), (99, 1, 1)]


def docs_of(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, mask string, n int")


def labels_of(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- 11: filter audit
def test_audit(spark):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.interactions(audit.histograms(docs_of(spark), labels_of(spark))).collect()}
    rows = []
    for i, t, s in DOCS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = [d for d, u, _ in DOCS if (u or "") == t and d is not None and i is not None and d < i]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(copies)}
        has = lambda k: i is not None and any(x[0] == i and x[k] == 1 for x in LABELS)
        rows.append((s or "", fails, has(1), has(2)))
    want, orders = {}, ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for o in orders:
            for step in range(1, 6):
                f, before = o[step - 1], o[: step - 1]
                out = [r for r in mine if r[1][f] and not any(r[1][b] for b in before)]
                kept = sum(not any(r[1][x] for x in o[:step]) for r in mine)
                redundant = sum(r[1][f] and any(r[1][b] for b in before) for r in mine)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                want[part, o, step] = [f, kept, len(out), redundant, unique, sum(r[2] for r in out), sum(r[3] for r in out)]
        for f in "ABCDE":
            of = [k for k in want if k[0] == part and want[k][0] == f]
            total = sum(want[k][2] for k in of)
            for k in of:
                want[k].append(total)
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == 600 * 4


def test_audit_of_nothing_and_without_labels(spark):
    assert audit.interactions(audit.histograms(docs_of(spark).limit(0), labels_of(spark))).count() == 0
    got = audit.interactions(audit.histograms(docs_of(spark), labels_of(spark).limit(0)))
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and got.count() == 2400


def test_matrices():
    m = audit.matrices()
    assert all(v.shape == (32, 600) and v.dtype == np.int64 for v in m.values())
    assert (m["removed"].sum(axis=1)[1:] == 120).all() and m["removed"][0].sum() == 0  # a failing document is removed once in every order


# ---- 12: quality
def test_network_equals_a_plain_one():
    r = np.random.default_rng(1)
    p = {"embed": r.normal(size=(256, quality.EMBED)), "kernels": r.normal(size=(quality.WIDTH, quality.EMBED, quality.KERNELS)), "bias": r.normal(size=quality.KERNELS), "hidden": r.normal(size=(quality.KERNELS, quality.HIDDEN)), "edge": r.normal(size=quality.HIDDEN), "out": r.normal(size=2 * quality.HIDDEN), "shift": np.array(0.1)}
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 4, 251, 252, 253, 256, 300, 508, 509, 512, 700, 3000, 40_000)]
    network = quality.Network(p)
    got = network.sums(texts)
    for t, z in zip(texts, got):
        blocks = max(1, -(-(len(t) + quality.WIDTH - 1) // quality.BLOCK))
        e = np.concatenate([np.zeros((quality.WIDTH - 1, quality.EMBED)), p["embed"][np.frombuffer(t, np.uint8)], np.zeros((blocks * quality.BLOCK - len(t), quality.EMBED))])
        conv = sum(e[j : j + blocks * quality.BLOCK] @ p["kernels"][j] for j in range(quality.WIDTH)) + p["bias"]
        chunks = [conv[a * quality.BLOCK : (a + 2) * quality.BLOCK] for a in range(max(1, blocks - 1))]
        u = np.maximum(np.array([np.maximum(c.max(axis=0), 0) for c in chunks]) @ p["hidden"] + p["edge"], 0)
        assert abs(np.concatenate([u.mean(axis=0), u.max(axis=0)]) @ p["out"] + 0.1 - z) < 1e-3 * (1 + abs(z))
        assert network.sums([t])[0] == z  # whatever texts stand beside it


def test_gradient_equals_differences():
    r = np.random.default_rng(2)
    p = quality.fit([b"abc def", b"xyz " * 300], np.array([1.0, 0.0]), np.ones(2), steps=3)
    texts, y, w = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in (40, 700, 1500)], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(q):
        z = quality.Network(q).sums(texts)
        return float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum())

    g = quality._gradient(p, texts, y, w)
    p = {k: np.array(v) for k, v in p.items()}
    for k, v in p.items():
        for at in [np.unravel_index(i, v.shape) for i in r.choice(v.size, min(4, v.size), replace=False)]:
            up, down = {n: np.array(x) for n, x in p.items()}, {n: np.array(x) for n, x in p.items()}
            up[k][at] += 3e-3
            down[k][at] -= 3e-3
            assert abs((loss(up) - loss(down)) / 6e-3 - g[k][at]) < 2e-2 * (abs(g[k][at]) + 0.05)


@data
def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op12_quality"](spark, SOURCE).collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SOURCE}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SOURCE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    held = [(got[d]["score"], got[d]["predicted"], q) for d, q in marks.items() if got[d]["held_out"]]
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([p == q for _, p, q in held]) > 0.95
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.98


def test_quality_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2), (None, None, 1, 2), (1, "a", 1, 2), (2, "", 1, 2)], "doc_id long, text string, Score int, `meta.x` int")
    got = quality.score(docs, None)
    assert got.columns == ["doc_id", "text", "meta.x", "score", "predicted"] and {r["score"] for r in got.collect()} == {0.5}
    labels = labels_of(spark, [(1, 1, 0), (2, None, 0), (None, 0, 0)])
    assert quality.train(docs, labels) is None  # no document of low quality
    assert quality.train(docs.limit(0), labels_of(spark, [(1, 1, 0), (2, 0, 0)])) is None
    model = quality.train(docs, labels_of(spark, [(1, 1, 0), (1, 0, 0), (2, 0, 0)]), steps=5)
    rows = quality.score(docs, model).collect()
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    assert len(quality.spread(b"x" * 1_000_000)) == quality.CHUNKS * 2 * quality.BLOCK and quality.spread(b"abc") == b"abc"


# ---- 13: ranked search
def plain_search(docs: list[tuple], items: dict, k: int) -> set:
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: Counter(term.findall((t or "").translate(lower)))
    held = [(d, terms(t)) for d, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items.items():
        scored = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("postings, shard_docs", [(1 << 19, 1 << 14), (60, 7), (1, 1)])
def test_search(spark, postings, shard_docs):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x9", "the", "THE"]
    share = np.concatenate([1 / np.arange(1, 61), [0.2, 0.2, 3, 1]])
    rows = [(int(i), " ".join(r.choice(vocabulary, r.integers(0, 60), p=share / share.sum()))) for i in r.permutation(150)]
    rows += [(1000 + i, "copy of w3 w50 ünï-ünï") for i in range(30)] + [(None, "copy of w3"), (None, None), (2000, None), (2001, "... !"), (2002, "w7 " * 5000), (5, "w3 w3"), (5, "w3 w3")]
    items = {1: "w3 W3 w50, copy", 2: "the THE the", 3: "nothing-known", 4: None, 5: "!!", 6: "ünï x9 w59 w58 w57", 7: " ".join(vocabulary)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, v, "x") for k, v in items.items()] + [(1, items[1], "x"), (None, "w3", "x")], "item_id long, text string, rank string")
    index, n, total = lexical.build_index(df, postings, shard_docs)
    got = [tuple(x) for x in lexical.search(index, n, asked, 10, most_queries=3 if postings == 60 else 100).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set((x[0], x[1]) for x in got)) and set(got) == plain_search(rows, items, 10)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index, n, _ = lexical.build_index(df.limit(0))
    assert n == 0 and lexical.search(index, n, asked).count() == 0
    index, n, _ = lexical.build_index(df.filter("doc_id = 2"))
    assert n == 0 and lexical.search(index, n, asked).count() == 0
    index, n, _ = lexical.build_index(df)
    assert n == 1 and lexical.search(index, n, asked.limit(0)).count() == 0
    assert lexical.search(index, n, asked).count() == 1


def test_bounds_leave_nodes_closed():
    """A query with a rare term opens few nodes of a shard."""
    r = np.random.default_rng(5)
    texts = [Counter(["common"] * int(r.integers(1, 4)) + [f"v{x}" for x in r.integers(0, 500, 40)] + (["rare"] if i % 500 == 7 else [])) for i in range(2000)]
    shard = lexical.Shard(lexical.build_shard(list(range(2000)), [sum(c.values()) for c in texts], [len(c) for c in texts], [t.encode() for c in texts for t in c], [x for c in texts for x in c.values()], 2000, sum(sum(c.values()) for c in texts)))
    q, s, d, opened = lexical.search_shard(shard, [{b"rare": 9000, b"common": 20}], np.zeros(1, dtype=np.int64), 3)
    assert set(d[np.argsort(-s)[:3]]) <= {7, 507, 1007, 1507} and opened < 200


# ---- names
@data
def test_stages_keep_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet").limit(120).withColumns({"Severity": F.lit(1), "Score": F.lit(2), "meta.x": F.lit(3), "Gone": F.lit(4), "turn": F.lit(5)})
    docs = docs.unionByName(docs.filter("doc_id % 50 = 0"))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_languages, corpus_pipeline.drop_near_duplicates):
        out = stage(spark, docs, SOURCE)
        assert out.columns == docs.columns and out.filter("Severity <> 1 or Score <> 2 or `meta.x` <> 3 or Gone <> 4 or turn <> 5").count() == 0 and out.count() > 50
    assert corpus_pipeline.best_fit_packing(spark, docs, SOURCE).count() >= 120
    assert language.identify(docs, {"langs": []}).columns == [c for c in docs.columns if c != "Score"] + ["lang_pred", "score", "evidence"]
    assert toxicity.judge(docs, {"weights": {}, "cuts": [20.0, 20.0]}).columns == [c for c in docs.columns if c != "Severity"] + ["severity", "p_toxic", "toxic"]
