"""JPEG and BMP files through the audit, against the pixels they were made from."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import images


def save(spark, pixels: np.ndarray, path, kind: str) -> bytes:
    """A file of the pixels (rows x columns x 1 or 3), encoded by the JVM."""
    jvm = spark._jvm
    h, w, n = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if n == 1 else 5)
    image.getRaster().setDataElements(0, 0, w, h, bytearray(pixels.tobytes()))
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))
    return path.read_bytes()


@pytest.fixture(scope="module")
def pixels():
    y, x = np.mgrid[0:72, 0:90]
    grey = np.uint8(127 + 100 * np.sin(x / 19 + y / 17))[:, :, None]
    return grey, np.dstack([grey, np.uint8(np.clip(grey.astype(int) - 60, 0, 255)), np.uint8(255 - grey)])


def test_whole_jpeg(spark, pixels, tmp_path):
    for p in pixels:
        data = save(spark, p, tmp_path / "a.jpg", "jpg")
        assert images.whole_jpeg(data) and images.whole_jpeg(data + b"what follows")
        assert not any(images.whole_jpeg(data[:k]) for k in range(2, len(data)))
        # A preview with an end mark of its own, in a segment before the scan, is not the end of the file.
        preview = b"\xff\xe1" + (2 + len(data)).to_bytes(2, "big") + data
        assert images.whole_jpeg(data[:2] + preview + data[2:]) and not images.whole_jpeg(data[:2] + preview + data[2:-2])
    assert not images.whole_jpeg(b"\xff\xd8\xff\xd9") and not images.whole_jpeg(b"\xff\xd8\xff")


def test_formats_in_the_audit(spark, pixels, tmp_path):
    grey, colour = pixels
    root = tmp_path / "all"
    root.mkdir()
    data = save(spark, grey, root / "grey scan+1.jpg", "jpg")
    save(spark, colour, root / "colour.jpeg", "jpg")
    save(spark, colour, root / "colour.bmp", "bmp")
    save(spark, grey, root / "grey.png", "png")
    save(spark, grey, root / "named_jpg_but.png.jpg", "png")
    (root / "cut.jpg").write_bytes(data[: len(data) * 2 // 3])
    (root / "head.jpg").write_bytes(data[:100])
    (root / "text.jpg").write_bytes(b"nothing of the kind")
    (root / "two.bmp").write_bytes(b"BM")
    table = images.audit_images(spark, str(root)).withColumn("file", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))))
    got = {r["file"]: r.asDict() for r in table.collect()}
    assert set(got) == {f.name for f in root.iterdir()}
    assert {f for f, r in got.items() if not r["readable"]} == {"cut.jpg", "head.jpg", "text.jpg", "two.bmp"}
    assert got["cut.jpg"]["format"] == "JPEG" and got["cut.jpg"]["mean"] is None and got["text.jpg"]["format"] is None
    for file, p in (("grey scan+1.jpg", grey), ("grey.png", grey), ("named_jpg_but.png.jpg", grey), ("colour.jpeg", colour), ("colour.bmp", colour)):
        want, r = images.statistics("L" if p is grey else "RGB", p), got[file]
        exact = not file.endswith((".jpeg", "1.jpg"))
        assert (r["mode"], r["width"], r["height"]) == (want["mode"], 90, 72)
        for k in ("mean", "std"):
            assert abs(r[k] - want[k]) <= (1e-9 if exact else 1), (file, k)
        far = bin(int(r["dhash"], 16) ^ int(want["dhash"], 16)).count("1")
        assert far == 0 if exact else far <= 4, file
    assert got["grey.png"]["format"] == got["named_jpg_but.png.jpg"]["format"] == "PNG" and got["colour.bmp"]["format"] == "BMP"
    assert abs(got["colour.jpeg"]["colour"] - got["colour.bmp"]["colour"]) < 2
    assert images.audit_images(spark, str(root)).filter("sha256 is null or bytes is null").count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """Pixels reach Python in batches that Spark bounds by bytes, not by rows alone."""
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 256 << 20
