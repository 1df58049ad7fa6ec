"""Byte-level BPE encoding and decoding on a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary: every byte string
becomes a piece of byte-mapped characters whose score is its negative rank, so
the best-scoring merge is the lowest rank; normalisation is the identity.
Texts are split into pre-tokens, distinct pre-tokens are encoded once, and ids
are decoded by the inverse byte map.

Defined cases: a null text is the empty text (no ids, the hash of nothing).
Repeated rows give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BEYOND = "\U00033480-\U000DFFFF"   # no letters are assigned here
LETTER = rf"[\p{{L}}--[{BEYOND}]]"
CACHE_ENTRIES = 200_000   # distinct pre-tokens remembered by a worker; emptied when full


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 bytes stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, data.splitlines()) if word}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    char = byte_characters()
    words = sorted(ranks, key=ranks.__getitem__)
    if [ranks[w] for w in words] != list(range(len(words))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = []
    for rank, word in enumerate(words):
        piece = "".join(char[b] for b in word).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    bpe, unk = 2, len(words)
    out.append(_field(2, _field(3, bpe) + _field(4, unk + 1) + _field(40, unk)
                      + b"".join(_field(n, -1) for n in (41, 42, 43))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes with one serialised model; lives in a worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The rank files' white space is the Unicode property.  The regex module also takes some
        # unassigned code points for letters, so texts that hold such get a pattern without them.
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(
            r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.plain = regex.compile(pattern).findall
        self.strict = regex.compile(pattern.replace(r"[^\p{White_Space}\p{L}", rf"[^\p{{White_Space}}{LETTER}")
                                    .replace(r"?\p{L}+", f"?{LETTER}+"), regex.V1).findall
        self.beyond = re.compile(f"[{BEYOND}]").search
        self.char = byte_characters()
        byte = {c: b for b, c in enumerate(self.char)}
        n = self.model.get_piece_size() - 1
        self.words = [bytes(map(byte.__getitem__, self.model.id_to_piece(i))) for i in range(n)]
        self.whole = {w: i for i, w in enumerate(self.words)}
        self.table = {b: c for b, c in enumerate(self.char)}
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.strict if not text.isascii() and self.beyond(text) else self.plain)(text)

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of new pre-tokens into the cache."""
        todo = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(todo) > CACHE_ENTRIES:
            self.cache = {}
            todo = list(tokens)
        cut = []
        for t in todo:
            raw = t.encode()
            if raw in self.whole:  # a word of the vocabulary is one id even if no merges lead to it
                self.cache[t] = struct.pack("<I", self.whole[raw])
            else:
                cut.append((t, raw.decode("latin-1").translate(self.table)))
        for (t, _), ids in zip(cut, self.model.encode([m for _, m in cut], num_threads=1), strict=True):
            self.cache[t] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        tokens = [self.split(t) for t in texts]
        self.learn(set().union(*tokens))
        return [b"".join(map(self.cache.__getitem__, ts)) for ts in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256 [, ids]) of every text; no shuffle.

    ``rank_file`` is read on the driver; the model made of it (about a
    megabyte, whatever the corpus) is broadcast.
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    with open(rank_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(f.read())))
    kind = src.schema[0].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(model.value, pattern)
            for part in T.slices(batch, "text"):
                ids = codec.encode([t or "" for t in part.column("text").to_pylist()])
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                          + ", ids binary" * keep_ids)
