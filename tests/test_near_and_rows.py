"""Near hashes block by block, and evaluation rows without joins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marlstone.operators import images
from marlstone.operators import textgen as G
from marlstone.plans import textgen_queries as Q

SF = "/root/testdata/sf0.001"


def test_links_and_forest_of_cut_buckets(spark):
    """Whatever the size of blocks, links are those of all pairs and the forest joins what they join, in at most an edge a hash and block."""
    r = random.Random(3)
    values = {r.getrandbits(64) & 0xFFFF00000000FFFF for _ in range(20)}
    for b in list(values):
        values |= {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(40)}
    name = lambda v: f"{v:016x}"
    near = {a: [b for b in values if a != b and (a ^ b).bit_count() <= 6] for a in values}
    df = spark.createDataFrame([(name(v),) for v in values] + [(None,), ("ff",)], "hash string")
    for block in (16, 4096):
        assert {x["hash"]: x["links"] for x in images.near_links(df, 6, 64, block).collect()} == {name(a): len(b) for a, b in near.items() if b}
    edges = images.near_forest(df, 6, 64).collect()
    assert len(edges) <= 7 * len(values) < sum(map(len, near.values())) / 2
    least = {}
    for a in sorted(values):
        if a not in least:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = a
                    todo += near[x]
    groups = images.perceptual_groups(spark.createDataFrame([(i, name(v)) for i, v in enumerate(values)], "id long, hash string"), 6, 64)
    assert {x["hash"]: x["label"] for x in groups.collect()} == {name(v): name(least[v]) for v in values}


def test_evaluation_row_reads_pairs_once(spark):
    """Equal to the measures made by joins; nothing is joined or sent to the driver."""
    made = Q.t6(spark, SF)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    p = Q.turns(spark, SF)
    long_ = lambda c, toks: p.select("id", Q.text.norm_sentences(F.col(c)).alias("sentences"), F.col(toks).alias("tokens"))
    want = G.copy_statistics(long_("hyp", "h"), long_("ref", "r"))
    for n in (1, 4):
        want = want.join(G.bleu(p.select("id", "h", "r"), n).withColumnRenamed("bleu", f"bleu{n}"), "id")
    names = ["id", "bleu1", "bleu4", "n_long", "n_copied", "copied_rate", "overlap_rate", "whole_copy"]
    rows = lambda df: sorted(tuple(x for x in r) for r in df.select(names).collect())
    got, other = rows(made), rows(want)
    assert len(got) == len(other) > 0 and all(abs(x - y) <= 1e-6 for a, b in zip(got, other) for x, y in zip(a, b))


def test_lookup_passes_on_asked_tokens_only(spark, tmp_path):
    """Rows of one doc_id count as one document; tokens nobody asks for are dropped where they are read."""
    from marlstone.plans import catalog

    spark.createDataFrame([(1, "a b a"), (1, "a x"), (2, "b y"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a b zz"), (8, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = catalog.QUERIES["j8_token_lookup"](spark, str(tmp_path))
    assert sorted(map(tuple, made.select("item_id", "token", "df", "hits", "total").collect())) == [(7, "a", 1, 1, 3), (7, "b", 2, 2, 2), (8, "b", 2, 2, 2)]
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_counts_in_lots(spark, monkeypatch):
    """Documents are counted a lot at a time; results do not depend on its size."""
    from marlstone.operators import retrieval

    docs = spark.createDataFrame([(i, [f"w{(i * k) % 11}" for k in range(1, 2 + i % 9)]) for i in range(80)] + [(99, []), (98, None)], "id long, t array<string>").coalesce(1)
    asked = spark.createDataFrame([(i, f"w{(i + j) % 13}") for i in range(8) for j in range(3)], "query long, token string")
    key = lambda: sorted((r["query"], r["rank"], r["id"], round(r["score"], 8)) for r in retrieval.lexical(docs, asked, 5).collect())
    whole = key()
    monkeypatch.setattr(retrieval, "LOT", 3)
    assert key() == whole and len(whole) == 40


def test_files_and_environment_are_met_by_tasks(spark):
    """Both read given tables in tasks: rows add up to the tables'."""
    from marlstone.plans import catalog

    held = {r["table"]: (r["rows"], r["keyed"], r["bytes"]) for r in catalog.QUERIES["a4_list_files"](spark, SF).collect()}
    assert len(held) == 14 and all(held[n][0] == held[n][1] == spark.read.parquet(f"{SF}/{n}.parquet").count() and held[n][2] > 0 for n in held)
    met = catalog.QUERIES["l10_environment"](spark, SF).collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {r["name"]: r["rows"] for r in met} == dict.fromkeys(["spark", "python", "numpy", "pandas", "pyarrow"], orders) and dict((r["name"], r["value"]) for r in met)["spark"] == spark.version


def test_lots_are_bounded_in_tokens(spark, monkeypatch):
    """Long documents are counted in smaller lots, one too long for any by itself; every document is in one lot, in order."""
    import pyarrow as pa

    from marlstone.operators import retrieval

    texts = [["a"] * n if n is not None else None for n in (3, 0, 4, 1, 30, None, 2, 7, 8, 0, 0, 0, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["id", "t"])
    monkeypatch.setattr(retrieval, "LOT", 3)
    monkeypatch.setattr(retrieval, "LOT_TOKENS", 8)
    assert [b.column("id").to_pylist() for b in retrieval.lots(batch)] == [[0, 1, 2], [3], [4], [5, 6], [7], [8, 9, 10], [11, 12]]
    assert [b.column("id").to_pylist() for b in retrieval.lots(batch.slice(3, 4))] == [[3], [4], [5, 6]]
    assert not list(retrieval.lots(batch.slice(0, 0)))

    docs = spark.createDataFrame([(i, [f"w{(i * k) % 11}" for k in range(1, 2 + i % 9)]) for i in range(80)] + [(99, []), (98, None)], "id long, t array<string>").coalesce(1)
    asked = spark.createDataFrame([(i, f"w{(i + j) % 13}") for i in range(8) for j in range(3)], "query long, token string")
    key = lambda: sorted((r["query"], r["rank"], r["id"], round(r["score"], 8)) for r in retrieval.lexical(docs, asked, 5).collect())
    cut = key()
    monkeypatch.setattr(retrieval, "LOT", 256)
    monkeypatch.setattr(retrieval, "LOT_TOKENS", 1 << 18)
    assert key() == cut and len(cut) == 40
