"""Text quality by a byte-level convolutional network.

Each byte has a learned vector of EMBED numbers, a filter spans WIDTH bytes. A filter's output is taken at every byte of the whole text
(rectified), pooled by maximum within each chunk of 2 x BLOCK bytes (chunks overlap by half, so every place is in two, the ends but
once). A chunk's vector goes through a layer of HIDDEN rectified units; their mean and maximum over the chunks go into one logistic unit.
Texts have as many chunks as they need.

In prediction the byte vectors and filters are multiplied out: a table for each place in a filter holds what each byte adds to all
filters there, so a text costs WIDTH look-ups a byte. Texts are laid one after another in blocks, padded with a symbol that adds nothing.

Training: a bounded sample (SAMPLE documents a class, by a hash of doc_id; of each CHUNKS chunks spread evenly over its whole
text) is gathered and fitted with numpy by Adam. Classes are weighted back to their shares among the labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, sliced, table, undotted, without_names

EMBED, WIDTH, KERNELS, HIDDEN, BLOCK, PAD = 8, 5, 24, 12, 256, 256
SAMPLE, CHUNKS, STEPS, BATCH, RATE, DECAY, SEED = 1500, 12, 900, 32, 0.01, 1e-4, 7
CUT = 0.3
#: Blocks that are convolved at once.
AT_ONCE = 128


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, block after block and WIDTH - 1 more, and each text's first block, with the end. Every text has a block at
    least, and begins with WIDTH - 1 padding symbols: a filter that runs over the end of one text meets these, not the next text."""
    sizes = np.array([max(1, -(-(len(t) + WIDTH - 1) // BLOCK)) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.full(int(first[-1]) * BLOCK + WIDTH - 1, PAD, dtype=np.int16)
    for at, t in zip(first, texts):
        begin = at * BLOCK + WIDTH - 1
        flat[begin : begin + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return flat, first


def convolve(flat: np.ndarray, tables: np.ndarray, bias: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter outputs (before rectifying) at every symbol of blocks first to last: blocks x BLOCK x filters."""
    a, n = first * BLOCK, (last - first) * BLOCK
    out = tables[0].take(flat[a : a + n], axis=0)
    for j in range(1, len(tables)):
        out += tables[j].take(flat[a + j : a + j + n], axis=0)
    out += bias
    return out.reshape(last - first, BLOCK, -1)


def chunked(pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks' maxima (of two neighbouring blocks of one text; of the only one), and each text's first chunk, with the end."""
    n = np.diff(first)
    start = np.repeat(first[:-1], np.maximum(n - 1, 1))
    ends = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 1))])
    at = start + np.arange(len(start)) - np.repeat(ends[:-1], np.maximum(n - 1, 1))
    other = np.minimum(at + 1, np.repeat(first[1:] - 1, np.maximum(n - 1, 1)))
    return np.stack([at, other]), ends


class Network:
    """A trained network, ready to score."""

    def __init__(self, model: dict):
        embed = np.concatenate([model["embed"], np.zeros((1, model["embed"].shape[1]))])  # PAD adds nothing
        self.tables = np.einsum("be,wef->wbf", embed, model["kernels"]).astype(np.float32)
        self.bias, self.out, self.shift = model["bias"].astype(np.float32), model["out"], model["shift"]
        self.hidden, self.edge = model["hidden"], model["edge"]

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """The last unit's sum for each text."""
        flat, first = blocks_of(texts)
        pooled = np.concatenate([convolve(flat, self.tables, self.bias, a, min(a + AT_ONCE, first[-1])).max(axis=1) for a in range(0, first[-1], AT_ONCE)])
        pair, ends = chunked(np.maximum(pooled, 0), first)
        h = np.maximum(np.maximum(pooled, 0)[pair[0]], np.maximum(pooled, 0)[pair[1]]).astype(np.float64)
        u = np.maximum((h[:, :, None] * self.hidden[None]).sum(axis=1) + self.edge, 0)  # not a product of matrices: a text's sum must not depend on its neighbours
        mean = np.add.reduceat(u, ends[:-1], axis=0) / np.diff(ends)[:, None]
        most = np.maximum.reduceat(u, ends[:-1], axis=0)
        return (np.concatenate([mean, most], axis=1) * self.out).sum(axis=1) + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(texts), -30, 30)))


def spread(text: bytes, chunks: int = CHUNKS) -> bytes:
    """At most `chunks` chunks of a text, evenly over all of it; the text itself if it has no more."""
    step, n = 2 * BLOCK, len(text)
    if n <= step * chunks:
        return text
    return b"".join(text[int(s) : int(s) + step] for s in np.linspace(0, n - step, chunks))


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = SEED) -> dict:
    """The network of least weighted logistic loss, by `steps` steps of Adam over shuffled batches, however many texts there are."""
    rng = np.random.default_rng(seed)
    prior = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "kernels": rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (WIDTH, EMBED, KERNELS)), "bias": np.zeros(KERNELS), "hidden": rng.normal(0, 1 / np.sqrt(KERNELS), (KERNELS, HIDDEN)), "edge": np.zeros(HIDDEN), "out": rng.normal(0, 0.05, 2 * HIDDEN), "shift": np.array(np.log(prior / (1 - prior)))}
    first_m, second_m = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    while step < steps:
        turn = rng.permutation(len(texts))
        for at in range(0, len(turn), BATCH):
            step += 1
            if step > steps:
                break
            mine = turn[at : at + BATCH]
            g = _gradient(p, [texts[i] for i in mine], y[mine], weight[mine])
            rate = RATE * (1 - (step - 1) / steps)
            for k, v in g.items():
                v = v + DECAY * p[k] * (k != "shift")
                first_m[k] = 0.9 * first_m[k] + 0.1 * v
                second_m[k] = 0.99 * second_m[k] + 0.01 * v * v
                p[k] = p[k] - rate * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.99**step)) + 1e-8)
    return p


def _gradient(p: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradient of the weighted mean loss of one batch. A maximum passes it on to the place it was taken at, so only WIDTH symbols for
    each chunk and filter have any."""
    flat, first = blocks_of(texts)
    embed = np.concatenate([p["embed"], np.zeros((1, EMBED))])
    tables = np.einsum("be,wef->wbf", embed, p["kernels"]).astype(np.float32)
    kernels = len(p["bias"])
    place, pooled = [], []
    for a in range(0, int(first[-1]), AT_ONCE):
        out = convolve(flat, tables, p["bias"].astype(np.float32), a, min(a + AT_ONCE, int(first[-1])))
        best = out.argmax(axis=1)
        place.append(best + (np.arange(len(best)) + a)[:, None] * BLOCK)
        pooled.append(np.take_along_axis(out, best[:, None, :], axis=1)[:, 0])
    place, pooled = np.concatenate(place), np.maximum(np.concatenate(pooled), 0).astype(np.float64)
    pair, ends = chunked(pooled, first)
    second = pooled[pair[1]] > pooled[pair[0]]
    h, where = np.where(second, pooled[pair[1]], pooled[pair[0]]), np.where(second, place[pair[1]], place[pair[0]])
    count = np.diff(ends)
    u = np.maximum(h @ p["hidden"] + p["edge"], 0)
    mean, most = np.add.reduceat(u, ends[:-1], axis=0) / count[:, None], np.maximum.reduceat(u, ends[:-1], axis=0)
    x = np.concatenate([mean, most], axis=1)
    z = x @ p["out"] + p["shift"]
    slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / weight.sum()
    own = np.repeat(np.arange(len(texts)), count)
    up = np.repeat(slope / count, count)[:, None] * p["out"][None, :HIDDEN]
    is_most = u == most[own]
    shares = np.add.reduceat(is_most.astype(np.float64), ends[:-1], axis=0)
    up = np.where(u > 0, up + is_most * (slope[:, None] * p["out"][None, HIDDEN:] / shares)[own], 0.0)
    down = np.where(h > 0, up @ p["hidden"].T, 0.0)
    c, f = np.nonzero(down)
    d, at = down[c, f], where[c, f]
    g_kernels, g_embed = np.zeros_like(p["kernels"]), np.zeros_like(embed)
    for j in range(WIDTH):
        symbol = flat[at + j].astype(np.int64)
        by_symbol = np.bincount(symbol * kernels + f, weights=d, minlength=(PAD + 1) * kernels).reshape(PAD + 1, kernels)
        g_kernels[j] = embed.T @ by_symbol
        g_embed += by_symbol @ p["kernels"][j].T
    return {"embed": g_embed[:-1], "kernels": g_kernels, "bias": down.sum(axis=0), "hidden": h.T @ up, "edge": up.sum(axis=0), "out": x.T @ slope, "shift": np.array(slope.sum())}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> dict | None:
    """A model for the label quality (0 or 1) of docs (doc_id, text); None without a labelled document of each kind.

    Labels with a null in doc_id or quality, and documents without a text, are left out; of several labels of a document the
    better counts. Equal texts of one label count once.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))  # about `sample` rows a class
    slim = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([spread(x.as_py()) for x in b.column("t")], pa.binary())], names=["doc_id", "y", "t"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("t", T.BinaryType())])
    rows = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "t").mapInArrow(run, schema).dropDuplicates(["t", "y"]).orderBy("doc_id", "t").collect()
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return fit([bytes(r["t"]) for r in rows], y, weight / weight.mean(), steps)


def score(docs: DataFrame, model: dict | None, cut: float = CUT) -> DataFrame:
    """Adds score (probability of quality) and predicted (1 from cut on) to docs; other columns of these names are replaced.

    Whole texts are read; a null text is empty and scored as such. Without a model every score is 0.5. Rows keep their
    place: no shuffle.
    """
    names = without_names(docs, ("score", "predicted"))
    kept = undotted(docs.select(*named(*names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(model) if model is not None else None
        for b in sliced(batches, 100):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            p = np.full(len(texts), 0.5) if network is None else network.scores(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])).toDF(*names, "score", "predicted")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    model = train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
