"""Image files: decoding and measures, quality flags, and a verdict with a reason.

PNG files (8 bits a channel, not interlaced) are decoded with zlib and numpy where they are read, so that checksums are verified and
transparency is kept; JPEG, BMP and TIFF files come from Spark's image source. That source also returns what it could save of a JPEG
file that is cut off; such a file is not readable here, since its markers are followed to the end mark. Flags and verdicts are column
expressions over a table of measures, whatever made it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.files import written
from . import ordered
from .graph import components

#: Limits of the audit's flags.
AUDIT = {"small_side": 128, "least_ratio": 0.5, "most_ratio": 2.0, "low_std": 5.0, "saturated": 0.90}
#: Limits of the verdict, hard ones first.
FORMATS = ["JPEG", "PNG", "BMP", "TIFF"]
HARD = {"least_side": 64, "most_side": 20000, "least_ratio": 0.25, "most_ratio": 4.0, "least_std": 2.0, "saturated": 0.90, "colour": 40.0}
WARN = {"small_side": 256, "least_ratio": 0.5, "most_ratio": 2.0, "dark": 30.0, "bright": 225.0, "colour": 10.0, "dominant": 0.40}
#: First bytes of formats; grey levels that count as black and white.
MAGIC = {"PNG": b"\x89PNG\r\n\x1a\n", "JPEG": b"\xff\xd8\xff", "BMP": b"BM", "TIFF": b"II*\x00", "GIF": b"GIF8"}
BLACK, WHITE = 5, 250
#: Formats that Spark's image source decodes; mode and order of its channels (blue, green, red, transparency) by their number.
ELSEWHERE = ("JPEG", "BMP", "TIFF")
DECODED = {1: ("L", [0]), 3: ("RGB", [2, 1, 0]), 4: ("RGBA", [2, 1, 0, 3])}
CHANNELS = {0: ("L", 1), 2: ("RGB", 3), 4: ("LA", 2), 6: ("RGBA", 4)}

MEASURES = "path string, bytes long, sha256 string, format string, readable boolean, mode string, width int, height int, mean double, std double, white double, black double, dominant double, colour double, transparent double, dhash string, dhash256 string"


def decode_png(data: bytes) -> tuple[str, np.ndarray]:
    """(mode, rows x columns x channels of bytes); ValueError for what is damaged or of another kind."""
    if not data.startswith(MAGIC["PNG"]):
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + chunk) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if head is None or len(head) != 13 or not ended:
        raise ValueError("cut off")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    if depth != 8 or colour not in CHANNELS or interlaced or not width or not height:
        raise ValueError("kind of PNG that is not decoded")
    mode, n = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError("damaged data") from e
    if len(raw) != height * (1 + width * n):
        raise ValueError("wrong size")
    lines = raw.reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width * n), dtype=np.uint8)
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # what stands to the left: a running sum of each channel
            out[y + 1] = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            got = [0] * n + [0] * (width * n)
            up = [0] * n + above.tolist()
            for i, v in enumerate(line.tolist(), n):
                a, b, c = got[i - n], up[i], up[i - n]
                if kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got[i] = (v + add) & 255
            out[y + 1] = got[n:]
        else:
            raise ValueError("unknown filter")
    return mode, out[1:].reshape(height, width, n)


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Grey levels (0 to 255) of rows x columns x channels; transparency is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int64)
    return (pixels[:, :, :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16  # fixed values: luma weights of 2^16


def _triangles(wide: int, narrow: int) -> np.ndarray:
    """Weights (narrow x wide, in units of 2^-22, each row about 2^22) of a resize from `wide` samples to `narrow` ones: triangles as
    broad as a new sample, never less than an old one."""
    scale = wide / narrow
    reach = max(scale, 1.0)
    out = np.zeros((narrow, wide))
    for i in range(narrow):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - reach + 0.5)), min(wide, int(centre + reach + 0.5))
        w = np.maximum(0.0, 1 - np.abs(np.arange(first, last) + 0.5 - centre) / reach)
        out[i, first:last] = w / w.sum()
    return np.floor(out * (1 << 22) + 0.5).astype(np.int64)


def resize(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Smooth resize, rows first, both steps rounded to whole grey levels."""
    narrow = lambda x: np.clip((x + (1 << 21)) >> 22, 0, 255)
    across = narrow(grey.astype(np.int64) @ _triangles(grey.shape[1], width).T)
    return narrow(_triangles(grey.shape[0], height) @ across)


def dhash(pixels: np.ndarray, side: int = 8) -> str:
    """Difference hash as hexadecimal text of side x side bits: whether each sample of the shrunk image is brighter than its left neighbour."""
    small = resize(grey_of(pixels), side + 1, side)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def words_of(hashes: Column, bits: int) -> Column:
    """A hash of hexadecimal text as an array of 32-bit numbers (as long)."""
    return F.array(*(F.conv(F.substring(hashes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(bits // 32)))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of equally many numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def near_hashes(hashes: DataFrame, radius: int, bits: int, equal: int = 2) -> DataFrame:
    """a, b, distance: pairs a < b of different hashes (column hash: hexadecimal text of `bits` bits) at most `radius` bits apart, each once. Pass
    distinct hashes; nulls and other lengths take no part.

    The bits are cut into radius + equal bands; two hashes within the radius agree in at least `equal` of them, so they meet under
    the values of some `equal` bands. A pair is taken at the first such choice of bands only. More equal bands make the
    meeting places rarer and more numerous.
    """
    bands = radius + equal
    if bands > bits:
        raise ValueError("more bands than bits")
    edges = [bits * i // bands for i in range(bands + 1)]
    picks = list(combinations(range(bands), equal))
    marked = hashes.filter(F.length("hash") == bits // 4).select("hash", words_of(F.col("hash"), bits).alias("w"))
    marked = marked.withColumn("text", F.array_join(F.transform("w", lambda w: F.lpad(F.conv(w.cast("string"), 10, 2), 32, "0")), ""))
    h = marked.select("hash", "w", F.array(*(F.conv(F.substring("text", a + 1, z - a), 2, 16) for a, z in zip(edges, edges[1:]))).alias("bands"))
    keyed = h.select("hash", "w", "bands", F.explode(F.array(*(F.struct(F.lit(n).alias("pick"), F.concat_ws("|", *(F.col("bands")[i] for i in pick)).alias("key")) for n, pick in enumerate(picks)))).alias("p")).select("hash", "w", "bands", "p.*")
    left, right = (keyed.select("pick", "key", *(F.col(c).alias(f"{c}_{side}") for c in ("hash", "w", "bands"))) for side in "ab")
    # The first choice of bands at which two hashes agree is that of the first bands in which they do.
    agree = F.slice(F.filter(F.transform(F.arrays_zip("bands_a", "bands_b"), lambda z, i: F.when(z["bands_a"] == z["bands_b"], i)), lambda i: i.isNotNull()), 1, equal)
    chosen = F.get(F.array(*(F.array(*map(F.lit, pick)) for pick in picks)), F.col("pick"))
    met = left.join(right, ["pick", "key"]).filter((F.col("hash_a") < F.col("hash_b")) & (agree == chosen))
    return met.select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"), hamming(F.col("w_a"), F.col("w_b")).alias("distance")).filter(F.col("distance") <= radius)


#: Hashes of one bucket compared with each other in one go; larger buckets are cut into blocks that meet pair by pair.
BLOCK = 4096


def _met(hashes: DataFrame, radius: int, bits: int, block: int, of_block, schema: str) -> DataFrame:
    """What of_block(hash, close) makes of every block of hashes that agree in a band (of radius + 1). close yields slices of pairs: arrays
    i, j of places in `hash`, at most `radius` bits apart, each pair of hashes in one block only, that of its first equal band."""
    bands, words = radius + 1, bits // 32
    if bands > bits:
        raise ValueError("more bands than bits")
    edges = [bits * i // bands for i in range(bands + 1)]
    masks = np.array([[sum(1 << (31 - p % 32) for p in range(a, z) if p // 32 == w) for w in range(words)] for a, z in zip(edges, edges[1:])], dtype=np.uint32)
    marked = hashes.filter(F.length("hash") == bits // 4).select("hash", words_of(F.col("hash"), bits).alias("w"))
    marked = marked.withColumn("text", F.array_join(F.transform("w", lambda w: F.lpad(F.conv(w.cast("string"), 10, 2), 32, "0")), ""))
    keys = F.array(*(F.struct(F.lit(n).alias("band"), F.substring("text", a + 1, z - a).alias("key")) for n, (a, z) in enumerate(zip(edges, edges[1:]))))
    keyed = written(marked.select("hash", *(F.col("w")[i].alias(f"w{i}") for i in range(words)), F.explode(keys).alias("k")).select("hash", *(f"w{i}" for i in range(words)), "k.*"), "bands")
    large = keyed.groupBy("band", "key").count().filter(F.col("count") > block).select("band", "key", F.ceil(F.col("count") / block).alias("blocks"))
    dealt = keyed.join(F.broadcast(large), ["band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))  # a row for each `block` rows at most
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("hash"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        band, low, high = key[0], key[2], key[3]
        w, own = b[[f"w{i}" for i in range(words)]].to_numpy().astype(np.uint32), b["own"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(left), 256):
                some = left[at : at + 256]
                far = sum(np.bitwise_count(w[some, None, c] ^ w[None, right, c]).astype(np.uint16) for c in range(words))
                i, j = np.nonzero(far <= radius)
                i, j = some[i], right[j]
                once = (i < j) if low == high else np.ones(len(i), dtype=bool)
                for n in range(band):  # met in an earlier band
                    once &= (((w[i] ^ w[j]) & masks[n]) != 0).any(axis=1)
                yield i[once], j[once]

        return of_block(b["hash"].to_numpy(), close)

    return dealt.groupBy("band", "key", "low", "high").applyInPandas(run, schema)


def near_links(hashes: DataFrame, radius: int, bits: int, block: int = BLOCK) -> DataFrame:
    """hash, links: how many other hashes are at most `radius` bits away, for those that have any. Pass distinct hashes. Pairs are formed and
    counted block by block, so that what is passed on grows with the hashes and not with their pairs."""

    def count(names: np.ndarray, close) -> pd.DataFrame:
        n = np.zeros(len(names), dtype=np.int64)
        for i, j in close():
            n += np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        return pd.DataFrame({"hash": names[n > 0], "links": n[n > 0]})

    return _met(hashes, radius, bits, block, count, "hash string, links long").groupBy("hash").agg(F.sum("links").alias("links"))


def near_forest(hashes: DataFrame, radius: int, bits: int, block: int = BLOCK) -> DataFrame:
    """a, b: edges that join the same hashes as all pairs at most `radius` bits apart do, at most one a hash and block. Pass distinct hashes."""

    def forest(names: np.ndarray, close) -> pd.DataFrame:
        label = np.arange(len(names))
        for i, j in close():
            while (label[i] != label[j]).any():
                low, tops = np.minimum(label[i], label[j]), label.copy()
                np.minimum.at(tops, label[i], low)
                np.minimum.at(tops, label[j], low)
                while (tops != tops[tops]).any():
                    tops = tops[tops]
                label = tops[label]
        joined = label != np.arange(len(names))
        return pd.DataFrame({"a": names[label[joined]], "b": names[joined]})

    return _met(hashes, radius, bits, block, forest, "a string, b string")


def perceptual_groups(rows: DataFrame, radius: int, bits: int) -> DataFrame:
    """id, hash, label: the smallest hash that can be reached by steps of at most `radius` bits. rows: id, hash. Equal hashes are one
    in the search for neighbours; rows without a hash are left out."""
    known = written(rows.filter(F.length("hash") == bits // 4).select("id", "hash"), "hashes")
    different = written(known.select("hash").distinct(), "hashes")
    linked = components(written(near_forest(different, radius, bits), "forest"))
    return ordered.attach(known, different.join(linked.withColumnRenamed("node", "hash"), "hash", "left").select("hash", F.coalesce("label", "hash").alias("label")), ["hash"])


def whole_jpeg(data: bytes) -> bool:
    """Whether a JPEG file's markers lead from its start through a scan to its end mark. What follows that mark does not count."""
    at, scanned = 2, False
    while 0 <= at and at + 2 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xD9:
            return scanned
        if kind == 0xFF:  # filling
            at += 1
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA:  # coded data: in it FF stands before 0 or a restart mark
            scanned, at = True, data.find(b"\xff", at)
            while 0 <= at and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at = data.find(b"\xff", at + 2)
    return False


def statistics(mode: str, pixels: np.ndarray) -> dict[str, object]:
    """Size, intensity measures and hashes of decoded pixels."""
    rgb = pixels[:, :, :3].astype(np.float64) if mode.startswith("RGB") else None
    grey = np.round(rgb @ np.array([0.299, 0.587, 0.114])) if rgb is not None else pixels[:, :, 0].astype(np.float64)
    colour = 0.0
    if rgb is not None:  # spread and mean of the opponent colours
        rg, yb = rgb[:, :, 0] - rgb[:, :, 1], (rgb[:, :, 0] + rgb[:, :, 1]) / 2 - rgb[:, :, 2]
        colour = float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))
    counts = np.bincount(grey.astype(np.uint8).ravel(), minlength=256)
    return {
        "mode": mode, "width": pixels.shape[1], "height": pixels.shape[0], "mean": float(grey.mean()), "std": float(grey.std()), "white": float((grey >= WHITE).mean()),
        "black": float((grey <= BLACK).mean()), "dominant": float(counts.max() / grey.size), "colour": colour, "transparent": float((pixels[:, :, -1] < 255).mean()) if mode.endswith("A") else 0.0,
        "dhash": dhash(pixels, 8), "dhash256": dhash(pixels, 16),
    }


def measure(data: bytes) -> dict[str, object]:
    """Format, size and measures of an image file's bytes, null where it is not decoded here; `readable` is null where that is left
    to Spark's image source."""
    kind = next((k for k, m in MAGIC.items() if data.startswith(m)), None)
    none = dict.fromkeys(("mode", "width", "height", "mean", "std", "white", "black", "dominant", "colour", "transparent", "dhash", "dhash256"))
    if kind in ELSEWHERE:
        return {"format": kind, "readable": None if kind != "JPEG" or whole_jpeg(data) else False} | none
    try:
        return {"format": kind, "readable": True} | statistics(*decode_png(data))
    except ValueError:
        return {"format": kind, "readable": False} | none


def _rows_of(measures: list[dict[str, object]], kept: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    out = pd.concat([kept, pd.DataFrame(measures, index=kept.index)], axis=1).reindex(columns=names)
    return out.astype({"width": "Int32", "height": "Int32"} | ({"readable": "boolean"} if "readable" in names else {}))


def decoded(spark: SparkSession, root: str, most: int) -> DataFrame:
    """path, mode, width, ... dhash256 of the files of at most `most` bytes under root that Spark's image source can decode,
    reduced where they are read."""
    schema = "path string, " + MEASURES[MEASURES.index("mode string") :]
    names = [c.split()[0] for c in schema.split(", ")]
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).filter(F.col("_metadata.file_size") <= most)
    found = found.select(F.col("_metadata.file_path").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, n, data in zip(b["height"], b["width"], b["nChannels"], b["data"]):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                out.append(statistics(DECODED[n][0], pixels[:, :, DECODED[n][1]]))
            yield _rows_of(out, b[["path"]], names)

    return found.mapInPandas(run, schema)


def audit_images(spark: SparkSession, root: str) -> DataFrame:
    """A row of measures for every file under root. PNG files are measured where their bytes are hashed, others where Spark's image
    source decodes them; the rows of both, without pixels, are joined by path. Spark's file source leaves out empty files; a join
    with what should be there finds them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    streamed = files.streams(found)
    path, size = F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")
    found = found.select(path, size) if streamed else found.select(path, size, F.sha2("content", 256).alias("sha256"), "content")
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not streamed:
                yield _rows_of([measure(bytes(x)) for x in b["content"]], b.drop(columns="content"), names)
                continue
            for i, uri in enumerate(b["path"]):  # a file at a time; only images that are decoded or followed here are held whole
                sha256, data = files.digest(uri, lambda head: head.startswith((MAGIC["PNG"], MAGIC["JPEG"])))
                yield _rows_of([measure(data)], b.iloc[i : i + 1].assign(sha256=sha256), names)

    own = written(found.mapInPandas(run, MEASURES), "measures")
    most = own.filter("readable is null").agg(F.max("bytes")).first()[0]
    if most is None:
        return own
    other = decoded(spark, root, most)  # no file above that size is left to Spark's image source, which holds files whole
    measured = [c for c in other.columns if c != "path"]
    both = own.join(other.select("path", *(F.col(c).alias(f"{c}_o") for c in measured)), "path", "left")
    left_open = F.col("readable").isNull()
    taken = {c: F.when(left_open, F.col(f"{c}_o")).otherwise(F.col(c)) for c in measured}
    return both.withColumns(taken | {"readable": F.coalesce("readable", F.col("height_o").isNotNull())}).select(*names)


def flags(exists: Column, referenced: Column, metadata: Column, extension: Column, expected: Column) -> dict[str, Column]:
    """The ten flags of an audited file, by name, over the columns of MEASURES."""
    side, ratio = F.least("width", "height"), F.try_divide(F.col("width"), F.col("height"))
    flat = (F.col("std") < AUDIT["low_std"]) | (F.col("white") >= AUDIT["saturated"]) | (F.col("black") >= AUDIT["saturated"])
    readable = F.col("readable")
    return {
        "missing_file": ~exists, "zero_byte": exists & (F.col("bytes") == 0), "unreadable_or_corrupt": exists & (F.col("bytes") > 0) & ~readable, "not_referenced": ~referenced, "metadata_file": metadata,
        "unusual_extension": F.coalesce(F.lower(extension) != expected, F.lit(True)), "non_grayscale": readable & ~F.col("mode").isin("L", "I;16", "I"), "suspiciously_small": readable & (side < AUDIT["small_side"]),
        "near_blank": readable & flat, "unusual_aspect_ratio": readable & ~ratio.between(AUDIT["least_ratio"], AUDIT["most_ratio"]),
    }


def verdict(exists: Column) -> tuple[Column, Column]:
    """(error, warnings) of a file over the columns of MEASURES. The first error in order counts, null if the image will do; warnings
    (array) are those met before it, since nothing is looked at after an error."""
    short, long_ = F.least("width", "height"), F.greatest("width", "height")
    ratio = F.try_divide(F.col("width"), F.col("height"))
    constant = F.when(F.col("mean") <= BLACK, "fully_black_image").when(F.col("mean") >= WHITE, "fully_white_image").otherwise("constant_image")
    stages: list[tuple[str, Column, Column | None]] = [  # kind, test, name of a computed error
        ("missing_file", ~exists, None), ("zero_byte_file", F.col("bytes") == 0, None), ("unreadable_image", ~F.col("readable"), None), ("unsupported_format", ~F.col("format").isin(FORMATS), None),
        ("invalid_dimensions", (short < HARD["least_side"]) | (long_ > HARD["most_side"]), None), ("extreme_aspect_ratio", ~ratio.between(HARD["least_ratio"], HARD["most_ratio"]), None),
        ("?small_image", short < WARN["small_side"], None), ("?unusual_aspect_ratio", ~ratio.between(WARN["least_ratio"], WARN["most_ratio"]), None), ("?transparency", F.col("transparent") > 0.01, None),
        ("strongly_colored_image", F.col("colour") >= HARD["colour"], None), ("?color_content", F.col("colour") >= WARN["colour"], None),
        ("constant", F.col("std") < HARD["least_std"], constant), ("nearly_white_image", F.col("white") >= HARD["saturated"], None), ("nearly_black_image", F.col("black") >= HARD["saturated"], None),
        ("?very_dark_image", F.col("mean") < WARN["dark"], None), ("?very_bright_image", F.col("mean") > WARN["bright"], None), ("?dominant_flat_region", F.col("dominant") >= WARN["dominant"], None),
    ]
    error, place = F.lit(None).cast("string"), F.lit(len(stages))
    for i, (kind, test, named) in reversed(list(enumerate(stages))):
        if not kind.startswith("?"):
            hit = F.coalesce(test, F.lit(False))
            error, place = F.when(hit, named if named is not None else F.lit(kind)).otherwise(error), F.when(hit, F.lit(i)).otherwise(place)
    warned = F.array(*[F.when(F.coalesce(test, F.lit(False)) & (F.lit(i) < place), F.lit(kind[1:])) for i, (kind, test, _) in enumerate(stages) if kind.startswith("?")])
    return error, F.filter(warned, lambda w: w.isNotNull())
