"""Files are hashed in blocks."""

from __future__ import annotations

import hashlib

from marlstone.operators import images
from marlstone.sources import files


def test_contents_are_no_rows(spark, tmp_path):
    """Names with blanks and signs, files of several blocks: hashes are those of whole files, and no plan reads contents."""
    made = {"a b%20.bin": b"x" * (files.BLOCK_BYTES + 5), "BM.txt": b"BM" + b"y" * 50, "c.png": b"\x89PNG\r\n\x1a\n" + b"z" * 99}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    want = sorted(hashlib.sha256(x).hexdigest() for x in made.values())
    found = files.audit_files(spark, str(tmp_path))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0] and sorted(r["sha256"] for r in found.collect()) == want
    rows = images.audit_images(spark, str(tmp_path)).collect()
    assert sorted(r["sha256"] for r in rows) == want and not any(r["readable"] for r in rows)
    assert {r["format"] for r in rows} == {None, "BMP", "PNG"}
