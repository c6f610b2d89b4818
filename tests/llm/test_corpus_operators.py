"""Corpus operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("marlstone.llm")
from marlstone.llm import bpe, fingerprints, jaccard, language, packing, tokens, topk, toxicity, training_order, urls, warc

LONG = " ".join(f"word{i % 97}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "a b c d", "Hello there, General  Kenobi!\n\n\nYou are a bold one. 12345 don't", "日本語のテキスト 🎉 <|endoftext|> tail", "x" * 5000, LONG, "same text five words here", "same text five words here", "Same TEXT five words here"]
SCHEMA = "doc_id long, text string, lang string, score double, toxic int, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2) for i, t in enumerate(TEXTS)], SCHEMA)


def rng_words(r, n, pool):
    return " ".join(r.choice(pool) for _ in range(n))


# ---- 2: BPE
def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib = Tokenizer.from_file(path)
    r = random.Random(0)
    odd = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x250), r.randrange(0x370, 0x3000), 32, 10])) for _ in range(150)) for _ in range(60)]
    own = bpe.encoder(path)
    for t in [t or "" for t in TEXTS] + odd:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want
        assert own.decode(np.array(want)) == lib.decode(want, skip_special_tokens=False)
        assert tokens.ids_of(t, tokens.default_ranks()).tolist() == want
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, path).collect()}
    assert len(got) == len(TEXTS) and all(got[i]["decoded"] == (t or "") for i, t in enumerate(TEXTS))
    digests = {r["doc_id"]: r for r in bpe.digest_documents(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        assert digests[i]["n_tokens"] == len(got[i]["ids"]) and digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], dtype="<u4").tobytes()).hexdigest()
    assert bpe.digest_documents(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", " \n"])
def test_ids_of_a_million_blanks(blank):
    from tokenizers import Tokenizer

    text = "one" + blank * (1_100_000 // len(blank)) + "two <|endoftext|> three"
    want = Tokenizer.from_file(bpe.default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert tokens.ids_of(text, tokens.default_ranks()).tolist() == want


# ---- 1: training order
def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, "k")) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, "k").tolist() != training_order.feistel(np.arange(1000), 1000, "other").tolist()


def test_shards_hold_every_sequence_once(spark, docs, tmp_path):
    path, ranks = str(tmp_path / "shards"), tokens.default_ranks()
    n = training_order.write_shards(docs.unionByName(docs.filter("doc_id = 5")), path, ranks, width=16, shard_bytes=40_000)
    assert n > 1
    rows = training_order.read_slots(spark, path, width=16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    parts = defaultdict(dict)
    for r in rows:
        parts[r["doc_id"]].setdefault(r["piece"], []).append(r["ids"])
    for i, t in enumerate(TEXTS):
        want = [*tokens.ids_of(t, ranks).tolist(), tokens.END_ID]
        copies = 2 if i == 5 else 1
        assert all(len(v) == copies for v in parts[i].values())
        assert [x for k in sorted(parts[i]) for x in parts[i][k][0]] == want
    some = training_order.read_slots(spark, path, first=7, count=30, width=16).collect()
    key = lambda rs: sorted((r["slot"], r["doc_id"], r["piece"], tuple(r["ids"])) for r in rs)
    assert key(some) == [k for k in key(rows) if 7 <= k[0] < 37]
    digest = training_order.read_slots(spark, path, width=16, digest=True).filter("slot = 3").first()["ids_crc32"]
    assert digest == zlib.crc32(np.array(next(r["ids"] for r in rows if r["slot"] == 3), dtype="<u4").tobytes())
    assert training_order.write_shards(docs.limit(0), str(tmp_path / "none"), ranks) == 0
    assert training_order.read_slots(spark, str(tmp_path / "none")).count() == 0
    assert training_order.resume(spark, str(tmp_path / "none"), 0) == []
    by_slot = {r["slot"]: (r["slot"], r["doc_id"], r["piece"], r["ids"]) for r in rows}
    for slot in (0, 5, len(rows) - 1):
        some = training_order.resume(spark, path, slot, 3, width=16)
        assert some and some == [by_slot[slot + k] for k in range(len(some))]
    assert training_order.resume(spark, path, len(rows), width=16) == []


def test_order_is_a_sort_by_permuted_numbers(spark, tmp_path):
    """Slots are ranks of the Feistel numbers of (document, piece), and each shard holds one range of them."""
    ranks, r = tokens.default_ranks(), random.Random(11)
    rows = [(i * 3 + 1, "word " * r.randrange(120)) for i in range(150)]
    path = str(tmp_path / "s")
    shards = training_order.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, ranks, key="k", width=16, shard_bytes=3000)
    most = (max(len(t) for _, t in rows) + 1 + 15) // 16
    low, high = rows[0][0], rows[-1][0]
    pieces = [(d, k) for d, t in rows for k in range(-(-(len(tokens.ids_of(t, ranks)) + 1) // 16))]
    place = training_order.feistel(np.array([(d - low) * most + k for d, k in pieces]), (high - low + 1) * most, "k")
    want = [x for _, x in sorted(zip(place.tolist(), pieces))]
    got = training_order.read_slots(spark, path, width=16).orderBy("slot").collect()
    assert [(x["doc_id"], x["piece"]) for x in got] == want
    assert [x["shard"] for x in got] == [p * shards // ((high - low + 1) * most) for p in sorted(place.tolist())] and shards > 5


def test_shards_of_null_and_wide_ids(spark, tmp_path):
    ranks, big = tokens.default_ranks(), (1 << 63) - 1
    rows = [(None, "no name " * 40), (None, None), (None, None), (big, "last " * 30), (-big, "first"), (big - 1, "a"), (5, "twice"), (5, "twice")] + [(None, f"other {i}") for i in range(40)]
    got = []
    for parts in (1, 5):
        path = str(tmp_path / f"s{parts}")
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert training_order.write_shards(df, path, ranks, width=16, shard_bytes=900) > 1
        got.append([(r["slot"], r["doc_id"], r["piece"], r["ids"]) for r in training_order.read_slots(spark, path, width=16).orderBy("slot").collect()])
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(len(got[0])))
    want = [(d, k // 16, ids[k : k + 16]) for d, t in rows for ids in [[*tokens.ids_of(t, ranks).tolist(), tokens.END_ID]] for k in range(0, len(ids), 16)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((r[1:] for r in got[0]), key=key) == sorted(want, key=key)
    sf = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(sf / "documents.parquet"))
    assert training_order.op1_training_order(spark, str(sf)).filter("doc_id is null").count() >= 43


@pytest.mark.parametrize("equal", [True, False])
def test_training_order_spreads_rows_of_one_id(spark, tmp_path, equal):
    ranks = tokens.default_ranks()
    rows = [(7, "the same text" if equal else f"text number {i}") for i in range(3000)] + [(i, f"another one {i}") for i in range(100, 400)]
    got = []
    for n in (1, 5):
        path = str(tmp_path / f"s{n}")
        shards = training_order.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), path, ranks, width=16, shard_bytes=10_000)
        sizes = [r["records"] for r in training_order.manifest(spark, path).collect()]
        assert shards > 8 and len(sizes) == shards and sum(sizes) == 3300 and max(sizes) < 1.5 * 3300 / shards
        got.append([(r["slot"], r["doc_id"], r["ids"]) for r in training_order.read_slots(spark, path, width=16).orderBy("slot").collect()])
    assert got[0] == got[1]


def test_training_order_holds_few_records():
    lots = [(len(a), len(b)) for a, b in training_order._in_lots((i, b"x") for i in range(2 * training_order.MOST_HELD + 5))]
    assert lots == [(training_order.MOST_HELD,) * 2] * 2 + [(5, 5)] and not list(training_order._in_lots(iter([])))


# ---- 6: packing
def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece_once(spark, docs):
    ranks = tokens.default_ranks()
    rows = packing.pack_documents(docs.unionByName(docs.limit(3)), ranks).collect()
    check_packing(rows, 2048)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.append(tokens.ids_of(t, ranks), 0).astype("<u4")
        copies = 2 if i < 3 else 1
        want = sorted((k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))) * copies
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(want)
    assert packing.pack_documents(docs.limit(0), ranks).count() == 0


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(1, 2048) == [(0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_tight(seed):
    r = random.Random(seed)
    counts = {n: r.randrange(1, 40) for n in r.sample(range(1, 513), 120)}
    plan = packing.plan_packing(dict(counts), 512)
    used = defaultdict(int)
    for members, bins in plan:
        assert sum(members) <= 512
        for n in members:
            used[n] += bins
    assert dict(used) == counts
    rooms: list[int] = []  # first fit of decreasing lengths
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(512 - n)
        else:
            rooms[at] -= n
    assert sum(b for _, b in plan) <= len(rooms)


# ---- 3: URLs
def test_url_parts_and_rules(spark):
    cases = [
        ("https://WWW.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/de/x", "a.example.net", "/de/x", "net/", "block"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.org/fr", "x.org", "/fr", None, None),
        ("http://x.net", "x.net", "", None, None),
        ("http://x.net?a://b/c", "x.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c/d#e", "b:", "//c/d", None, None),
        ("http://É.NET/\npath", "É.net", "/\npath", "net/", "block"),
        ("http://" + "h" * 20000 + ".com/" + "p" * 20000, "h" * 20000 + ".com", "/" + "p" * 20000, None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, score string")
    got = {r["page_id"]: r for r in urls.judge(pages, [0.0] * urls.DIMENSIONS + [-1.0]).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), cases[i][0][:40]
    assert urls.judge(pages.limit(0), [0.0] * (urls.DIMENSIONS + 1)).count() == 0


def test_url_training_equals_plain_gradient_descent(spark, monkeypatch):
    rows = [(f"https://{'bet' * (i % 2)}site{i}.com/p{i % 3}", i % 2) for i in range(14)] + [(None, 1), ("http://x", None)]
    df = spark.createDataFrame(rows, "url string, block int")
    w = np.array(urls.train(df, rounds=7))
    parts = df.filter("url is not null and block is not null").select(urls.host_of("url").alias("host"), urls.path_of("url").alias("path"), "block")
    found = urls.add_features(parts).select("block", F.col("features").alias("f")).collect()
    grams = {"".join(c) for n in urls.GRAMS for c in zip(*("^site0.com$"[k:] for k in range(n)))}
    assert len(urls.add_features(parts).filter("host = 'site0.com'").first()["features"]) <= len(grams) + sum(max(0, len("^/p0$") - n + 1) for n in urls.GRAMS)
    x = np.zeros((len(found), urls.DIMENSIONS))
    for i, r in enumerate(found):
        x[i, r["f"]] = 1 / np.sqrt(len(r["f"]))
    y, v, b = np.array([float(r["block"]) for r in found]), np.zeros(urls.DIMENSIONS), 0.0
    for _ in range(7):
        e = (y - 1 / (1 + np.exp(-(b + x @ v)))) / len(y)
        v, b = v * (1 - urls.RATE * urls.RIDGE) + 4 * urls.RATE * (e @ x), b + urls.RATE * e.sum()
    assert np.allclose(w[:-1], v) and abs(w[-1] - b) < 1e-9 and abs(v).max() > 0.1
    assert urls.train(df.filter("block = 1")) == [0.0] * (urls.DIMENSIONS + 1) and urls.train(df.limit(0)) == [0.0] * (urls.DIMENSIONS + 1)
    monkeypatch.setattr(urls, "MOST_LABELLED", 13)
    with pytest.raises(ValueError, match="more than 13"):
        urls.train(df)


def test_url_classifier_held_out(spark):
    table = urls.labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(5)))
    right = total = 0
    for fold in (0, 1):
        w = urls.train(urls.reshaped(table.filter(F.col("fold") != fold)))
        rows = [(i, r["url"], r["block"]) for i, r in enumerate(table.filter(F.col("fold") == fold).collect())]
        held = spark.createDataFrame(rows, "page_id long, url string, block int")
        got = urls.judge(held, w, rules=[]).join(held, "page_id")
        right += got.filter((F.col("verdict") == "block") == (F.col("block") == 1)).count()
        total += len(rows)
    assert total > 60 and right >= 0.72 * total  # 0.80 over all five folds; brand names cannot be guessed


def test_url_classifier_on_names_it_has_not_seen(spark):
    table = urls.labelled_urls(spark)
    seen = " ".join(r["url"] for r in table.select("url").collect())
    bad = "adult-x adult-friend porn-tube hotporn casino-win casinoplay poker-room lottery-winner cheap-pills cheapviagra loans-today free-bets betting-tips banner-network spam-mailer spam-farm ads-track".split()
    good = "thther velkaro mirandel tiontion river-house city-museum open-source-hub zimmermann wikipedia mozilla github lakeside-school essex-council sunny-day hartford linux-kernel".split()
    assert not [n for n in bad + good if n in seen]
    rows = [(k, f"http://{www}{n}.{top}{path}", n, n in bad) for k, (n, www, top, path) in enumerate((n, w, t, p) for n in bad + good for w in ("", "www.", "m.") for t in ("com", "org") for p in ("/", "/en/7", "/es/12.html"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, name string, bad boolean")
    w = urls.train(urls.reshaped(table))
    got = urls.judge(pages, w, rules=[]).join(pages, "page_id").groupBy("name", "bad").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("blocked")).collect()
    by = {r["name"]: r["blocked"] for r in got}
    assert sum(by[n] for n in bad) >= 0.8 * len(bad) and sum(by[n] for n in good) <= 0.05 * len(good), by
    own = table.select(F.monotonically_increasing_id().alias("page_id"), "url", "block").collect()
    own = spark.createDataFrame(own, "page_id long, url string, block int")
    assert urls.judge(own, w, rules=[]).join(own, "page_id").filter((F.col("verdict") == "block") == (F.col("block") == 1)).count() >= 0.97 * own.count()


# ---- 4: top k
@pytest.mark.parametrize(("page", "fanout"), [(2048, 32), (20, 4)])
def test_top_k_equals_brute_force(spark, page, fanout, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", page)
    monkeypatch.setattr(topk, "FANOUT", fanout)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "LEAF", 8)
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6)) + np.repeat(r.normal(size=(8, 6)) * 4, 50, axis=0)
    x[100:180] = x[100]  # a frequent vector
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    rows += [(1000, None, 0), (1001, [float("nan")] * 6, 0), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1003, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), rows[7]]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    got = sorted(tuple(z) for z in topk.top_k(df, df.filter(F.col("vec_id") % 25 == 0)).select("query_id", "rank", "vec_id", "score").collect())
    v = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 25):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        want += [(q, k + 1, i, -m) for k, (m, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_small_tables(spark):
    df = topk.quantised(spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>"))
    got = topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_of_ids_with_several_vectors(spark):
    rows = [(0, [9.0 + i, 1.0]) for i in range(8)] + [(50, [5.0, 5.0]), (50, [6.0, 1.0])] + [(i, [i / 10, 1.0]) for i in range(1, 9)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(df, df.filter("vec_id = 0 and v[0] = 9 * 256")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 50), (2, 50), (3, 8), (4, 7), (5, 6)]


def test_top_k_skips_most_of_clustered_vectors(spark, monkeypatch):
    """The tree has levels, and stored distances save nearly all inner products and centre distances."""
    monkeypatch.setattr(topk, "PAGE", 200)
    monkeypatch.setattr(topk, "FANOUT", 8)
    monkeypatch.setattr(topk, "LEAF", 16)
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(60, 16)) * 2, 50, axis=0) + r.normal(size=(3000, 16)) * 0.1
    rows = topk.quantised(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    tree = topk.Tree(topk.distinct_vectors(rows, 6), topk.Space(16, float((np.floor(256 * x) ** 2).sum(axis=1).max())))
    assert tree.routing.filter("node <> '0'").count() > 0 and tree.pages.count() > 15
    found = topk.search(tree, rows.filter("vec_id % 50 = 0").select("v").distinct(), 6)
    formed = found.agg(F.sum("cost")).first()[0] / (60 * 3000)
    assert formed < 0.35  # what is computed, not only what is asked for


def test_top_k_of_huge_components(spark):
    big = [[1e17, 1.0], [1e17, 2.0], [-3e17, 0.0], [1e30, 1.0], [0.0, 0.0], [1e7, -1e7]]
    rows = [(50 * i, v) for i, v in enumerate(big)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    clip = lambda v: max(-topk.MOST_LONG, min(topk.MOST_LONG, v))
    whole = [[clip(int(np.floor(256 * c))) for c in v] for v in big]
    want = []
    for i, q in enumerate(whole):
        best = sorted((-clip(sum(a * b for a, b in zip(q, v))), 50 * j) for j, v in enumerate(whole) if j != i)[:5]
        want += [(50 * i, k + 1, j, -m) for k, (m, j) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, df).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


# ---- 5: fingerprints
def test_fingerprints(spark, docs):
    r = random.Random(2)
    pool = [f"w{i}" for i in range(5000)]
    base = rng_words(r, 1500, pool)
    rows = [(i * 7, t) for i, t in enumerate(TEXTS)] + [(1000, base), (1001, base + " " + rng_words(r, 1500, pool)), (1002, base)]
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, hashes string")
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[63]["fingerprint"] == got[70]["fingerprint"] and got[70]["near_next"] == 1.0
    assert 0.35 < got[1001]["near_next"] < 0.65 and 0.3 < got[1000]["near_edited"] < 0.75 and got[0]["near_edited"] == 1.0
    twice = {(x["doc_id"], x["edited_sha256"]) for x in fingerprints.fingerprint_edits(df.unionByName(df.filter("doc_id = 1000"))).collect()}
    assert twice == {(i, x["edited_sha256"]) for i, x in got.items()}
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0
    one = fingerprints.fingerprint_edits(df.filter("doc_id = 35")).first()
    t = TEXTS[5]
    assert one["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + t[: len(t) // 3]).encode()).hexdigest() and one["near_next"] == 1.0


def test_containment_and_merge(spark):
    r = random.Random(3)
    pool = [f"w{i}" for i in range(9000)]
    small = rng_words(r, 400, pool)
    large = small + " " + rng_words(r, 8000, pool)
    df = spark.createDataFrame([(small, large)], "a string, b string")
    x = fingerprints.add_sketch(fingerprints.add_sketch(df, "a", "a_"), "b", "b_")
    assert x.select(fingerprints.containment("a_limit", "a_hashes", "b_limit", "b_hashes")).first()[0] > 0.95
    parts = fingerprints.add_sketch(spark.createDataFrame([(small,), (large,)], "t string"), "t")
    limit, hashes = fingerprints.merge(F.col("limit"), F.col("hashes"))
    merged = parts.agg(limit.alias("least"), hashes.alias("kept")).first()
    assert merged["kept"] == x.first()["b_hashes"]


# ---- 7: language
def language_table(spark, n=400):
    r = random.Random(4)
    stems = {"aa": ["kala", "vesi", "talo", "puu"], "bb": ["schloss", "wasser", "haus", "baum"], "cc": ["château", "rivière", "maison", "arbre"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(stems))
        rows.append((i, rng_words(r, r.randrange(3, 60), [a + b for a in stems[lang] for b in ("", "s", "en", "la", "io")]).replace("kalas", f"kala{i}"), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark):
    df = language_table(spark)
    model = language.train(df.filter(~language.held_out()))
    got = language.identify(df.withColumn("held_out", language.held_out()), model).filter("held_out")
    assert got.count() > 80 and got.filter("lang_pred = lang").count() >= 0.97 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! ½²"), (4, "schlossburgen"), (5, "WASSER " * 20000), (6, "Ωμέγα")], "doc_id long, text string").withColumn("score", F.lit("x"))
    r = {x["doc_id"]: x for x in language.identify(odd, model).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and r[4]["lang_pred"] == r[5]["lang_pred"] == "bb" and r[6]["lang_pred"] in model["langs"]
    assert all(0 <= x["score"] <= 1 for x in r.values())
    none = language.train(df.limit(0))
    assert language.identify(odd, none).filter("lang_pred <> 'und'").count() == 0 and language.identify(odd.limit(0), model).count() == 0


# ---- 8: Jaccard join
def brute(rows):
    sets, inverted, parent = {}, defaultdict(list), {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in inverted[s]:
                common[j] += 1
            inverted[s].append(i)
        for j, o in common.items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def family_rows():
    r = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    base, passage, chain = (rng_words(r, n, pool).split() for n in (120, 60, 90))
    rows = []
    for _ in range(120):
        x = list(base)
        for _ in range(r.randrange(5)):
            x[r.randrange(len(x))] = r.choice(pool)
        rows.append(" ".join(x))
    rows += [" ".join([rng_words(r, r.randrange(1, 40), pool), *passage, rng_words(r, r.randrange(1, 40), pool)]) for _ in range(80)]
    rows += [" ".join([*passage, rng_words(r, r.randrange(1, 14), pool)]) for _ in range(60)]
    for _ in range(40):
        chain = list(chain)
        for _ in range(2):
            chain[r.randrange(len(chain))] = r.choice(pool)
        rows.append(" ".join(chain).upper() if r.random() < 0.2 else " ".join(chain))
    rows += ["a"] * 3 + ["A B c"] * 2 + [*(t or "" for t in TEXTS)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("small", "least", "most"), [(96, 4, 2_000_000), (3, 2, 2_000_000), (3, 2, 40)])
def test_jaccard_join_is_exact(spark, family_rows, monkeypatch, small, least, most):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SHARE", 7 * small)
    monkeypatch.setattr(jaccard, "LEAST_LARGE", small // 2)
    monkeypatch.setattr(jaccard.frequent_shingles, "__defaults__", (1 if small == 3 else 16, least, most))
    df = spark.createDataFrame([(i, t, 1) for i, t in family_rows] + [(None, "x y z", 1)], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute(family_rows)


@pytest.mark.parametrize("small", [96, 3])
def test_jaccard_links_are_all_links(spark, family_rows, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard.frequent_shingles, "__defaults__", (1 if small == 3 else 16, 2, 2_000_000))
    links, members = jaccard.jaccard_links(spark.createDataFrame([*family_rows, (None, "x y z")], "doc_id long, text string"))
    sets = {}
    for i, t in family_rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {(r["doc_id"], r["representative"]) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    reps = sorted(first.values())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(reps) for b in reps[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [((r["a"], r["b"]), r["similarity"]) for r in links.collect()]
    assert dict(got) == pytest.approx(want) and len(got) == len(want) > 1000


def test_jaccard_small_tables(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs.unionByName(docs)).collect()}
    assert got == brute(list(enumerate(TEXTS)))
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


# ---- 9: WARC
INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.fixture
def small_blocks(spark):
    """Files that are not compressed are read in blocks of 300 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, small_blocks, compression):
    html = [None, "", "short", "short", "é" * 80, "é" * 80, "é" * 80, INNER, INNER * 30, "WARC/1.1\r\n" * 50, "tail\r\n\r\n", "WARC/1.", LONG[:5000], "x" * 99, "x" * 99, "x" * 100, "x" * 100]
    rows = [(100 - i, f"http://h/{i}\r\nX: y" if i % 3 else None, t, "z") for i, t in enumerate(html)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), path, compression=compression)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, url, t, _ in sorted(rows):
        b = (t or "").encode()
        d = hashlib.sha256(b).hexdigest()
        refers = first.get(d) if len(b) >= 100 else None
        first.setdefault(d, i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["record_type"]) == (len(b), d, refers, "revisit" if refers else "response")
        assert r["url"] == (url.replace("\r\n", "%20%20").replace(" ", "%20") if url else "urn:none") and (r["payload"] is None if refers else bytes(r["payload"]) == b)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_frequent_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_FREQUENT", 3)
    rows = [(i, f"u{i}", ("a" if i % 3 else "b" * (i % 5 + 1)) * 120) for i in range(60)] + [(None, "u", "a" * 120), (4, "again", "a" * 120)]
    got = {(r["page_id"], r["url"]): r["first"] for r in warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, t in rows[:60]:
        first.setdefault(t, i)
    assert got == {(i, u): first[t] if i is not None and i > first[t] else None for i, u, t in rows}


def record(body: bytes, kind: bytes = b"resource") -> bytes:
    return b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, len(body)) + body + b"\r\n\r\n"


def sequential(data: bytes) -> list[bytes]:
    """The blocks of an archive, one record after another."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        n = int(re.search(rb"Content-Length: (\d+)", data[at:stop])[1])
        out.append(data[stop : stop + n])
        at = stop + n + 4
    return out


def test_boundary_chain_rejects_what_is_inside(spark, tmp_path, small_blocks):
    r, inner = random.Random(8), INNER.encode()
    liar = b"WARC/1.0\r\nContent-Length: 40\r\n\r\n"  # its successor is inside or behind the record it stands in
    bodies = [inner, b"a", inner * 3 + b"WARC/1.1\r\n", b"", liar, liar + inner, b"WARC/1." * 40, b"\r\n\r\nWARC/1.1\r\n"]
    want = []
    (tmp_path / "w").mkdir()
    for k in range(4):
        data = b"".join(record(b"".join(r.choice([*bodies, b"plain text "]) for _ in range(r.randrange(6)))) for _ in range(30))
        want += sequential(data)
        (tmp_path / "w" / (f"{k}.warc" + ".gz" * (k % 2))).write_bytes(b"".join(gzip.compress(record(x)) for x in sequential(data)) if k % 2 else data)
    got = [bytes(x["payload"]) for x in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    assert sorted(got) == sorted(want) and sum(b"WARC/1." in x for x in want) > 40


def test_warc_long_headers_and_damage(spark, tmp_path):
    rows = [(i, "http://h/" + "u" * n, f"page {i}") for i, n in enumerate((5, 70_000, 300_000, 5))]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    assert {(r["page_id"], r["url"], bytes(r["payload"])) for r in warc.read_archives(spark, path).collect()} == {(i, u, t.encode()) for i, u, t in rows}
    marks = [b"WARC/1.1\r\n" * 2000, b"WARC/1.1\r\nContent-Length: 7\r\n" * 2000]  # many places without a header's end
    data = b"".join(map(record, (b"a", *marks, b"b")))
    at = tmp_path / "one.warc"
    at.write_bytes(data)
    assert sorted(bytes(r["payload"]) for r in warc.read_archives(spark, str(at)).collect()) == sorted([b"a", *marks, b"b"])
    for bad in (data[:-1], data[:-50], data + b"x", data + b"WARC/1.", data.replace(b"Length: 1\r", b"Length: 2\r", 1), b"junk" + data, b"junk"):
        at.write_bytes(bad)
        with pytest.raises(ValueError, match="damaged"):
            warc.read_archives(spark, str(at))
    at.write_bytes(record(b"HTTP/1.1 200 OK\r\n\r\nx", b"response").replace(b"Content-Length", b"WARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\nContent-Length"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archives(spark, str(at)).collect()


# ---- 10: toxicity
def test_ordinal_regression_recovers_order():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=3000)
    w, cuts = toxicity.fit_ordinal(x, (z > 1).astype(int) + (z > 3))
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 1) < 0.25 and abs(w[2]) < 0.2 and abs(cuts[0] - 1) < 0.3 and abs(cuts[1] - 3) < 0.4


def test_toxicity(spark):
    r = random.Random(7)
    pool = [f"plain{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(500):
        bad = r.random() < 0.2
        words = rng_words(r, 60, pool).split() + [r.choice(["vileword", "nastystem" + r.choice(["a", "es", "ing"])]) for _ in range(r.randrange(1, 6) if bad else 0)]
        r.shuffle(words)
        rows.append((i, " ".join(words), 9))
        marks.append((i, 1, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels.filter("doc_id is null or doc_id < 350"))
    got = toxicity.judge(df, model).join(labels.filter("doc_id >= 350").withColumnRenamed("toxic", "y"), "doc_id")
    assert got.filter(F.col("toxic") != (F.col("y") == 1)).count() <= 3
    odd = toxicity.judge(spark.createDataFrame([(1, None), (2, ""), (3, LONG + " vileword vileword nastystemen")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x["toxic"] for x in odd] == [False, False, True] and 0 <= odd[0]["severity"] < odd[2]["severity"] <= 2
    nothing = toxicity.train(df, labels.limit(0))
    assert toxicity.judge(df, nothing).filter("toxic").count() == 0 and toxicity.judge(df.limit(0), model).count() == 0
