"""Byte-level BPE by backtracking over longest matches.

Encoding. A pre-tokenised word is covered by tokens. An Aho-Corasick automaton over all vocabulary entries reports every
token occurrence in one pass, which gives the longest token that starts at each byte. The encoder takes the longest one; it
may stand after its predecessor only if the pair is *compatible*: merging the two tokens' bytes by merge priority would
give back exactly these two tokens. If not, it tries the next shorter token (a prefix table), and if none fits it steps
back one token. End positions found useless are marked and never tried again, so each is left at most once and the work is
linear in the word. The result is the one that merging pairs by priority gives.

Decoding. All tokens' bytes stand in one buffer; an offset table gives each id's slice.

Words repeat, so every worker keeps a bounded two-generation table of word to packed ids.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept per generation and worker; a word longer than LONG_WORD characters is not kept.
KEPT_WORDS, LONG_WORD = 200_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word to packed little-endian ids, computed at first use; two generations bound its size."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = np.asarray(self.encode(word.encode("utf-8")), dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class BacktrackingBpe:
    """A vocabulary file's encoder and decoder; ids and text equal those of the file's own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        tokens = [b""] * size
        for text, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in text)
        # Priorities: bytes first, then tokens by the merge that makes them.
        rank_of, self.id_of, self.parts, self.pairs = {}, [], [], {}
        for text, i in vocab.items():
            if len(text) == 1:
                rank_of[text] = len(self.id_of)
                self.id_of.append(i)
                self.parts.append(None)
        for a, b in merges:
            left, right = rank_of[a], rank_of[b]
            r = rank_of.get(a + b)
            if r is None:
                r = rank_of[a + b] = len(self.id_of)
                self.id_of.append(vocab[a + b])
                self.parts.append((left, right))
            self.pairs.setdefault((left, right), r)
        words = [tokens[i].decode("latin-1") for i in self.id_of]
        self.length = [len(w) for w in words]
        at = {w: r for r, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for r, w in enumerate(words):
            self.automaton.add_word(w, r)
        self.automaton.make_automaton()
        self.shorter = [next((at[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in at), -1) for w in words]
        self._compatible: dict[tuple[int, int], bool] = {}
        self.byte_rank = {t.decode("latin-1"): at[t.decode("latin-1")] for t in {tokens[i] for i in self.id_of} if len(t) == 1}
        # Decoding.
        for text, i in self.special.items():
            tokens[i] = text.encode("utf-8")
        self.buffer = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.packed_special = {s: np.asarray([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        self.words = _Words(self.encode_word)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by priority keeps the border between tokens a and b."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self._keeps_border(a, b)
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        # Undo merges of the later-made side, step by step. A merge over the border that comes before the side was made
        # would have taken its parts first.
        limit = len(self.id_of)
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                undone_left = self.parts[a] is not None
            else:
                undone_left = self.parts[b] is None
            side = a if undone_left else b
            if self.parts[side] is None:
                return True
            if undone_left:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        text, n = word.decode("latin-1"), len(word)
        longest = [-1] * n
        length = self.length
        for end, r in self.automaton.iter(text):
            start = end + 1 - length[r]
            if longest[start] < 0 or length[r] > length[longest[start]]:
                longest[start] = r
        usable, out, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if usable[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    usable[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
        return [self.id_of[r] for r in out]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        word = self.words.__getitem__
        if self.specials is None or not any(s in text for s in self.special):
            return b"".join(map(word, self.pattern.findall(text)))
        return b"".join(self.packed_special[part] if part in self.packed_special else b"".join(map(word, self.pattern.findall(part))) for part in self.specials.split(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        return self.buffer[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBpe:
    """One encoder for each vocabulary file and worker."""
    return BacktrackingBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and the text decoded from them, for each row.

    Null text encodes as empty, empty text as no ids; a null id stays null; repeated rows give repeated rows; other columns
    are ignored; an empty table gives an empty one. Rows keep their place: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in sliced(batches):
            ids = [bpe.encode(t or "") for t in b.column("t").to_pylist()]
            packed = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), packed, pa.array([bpe.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: encode_documents with its outputs digested inside the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in sliced(batches):
            rows = []
            for t in b.column("t").to_pylist():
                packed = bpe.encode_packed(t or "")
                decoded = bpe.decode_bytes(np.frombuffer(packed, dtype="<u4"))
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.decode("utf-8", errors="replace").encode("utf-8")).hexdigest(), len(decoded)))
            n, ids, text, size = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text), pa.array(size, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def crc(packed: bytes) -> int:
    return zlib.crc32(packed) & 0xFFFFFFFF


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_vocabulary())
