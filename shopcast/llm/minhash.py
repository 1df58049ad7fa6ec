"""Document fingerprints: one-permutation MinHash.

Every shingle of five words is hashed once; the top bits choose one of ``bins``
bins and each bin keeps its smallest value.  Empty bins copy a non-empty bin
found by a random probe sequence that depends only on the bin (optimal
densification), so two sets probe alike.  Of every value ``bits`` low-order
bits are stored; agreement by chance is taken out when fingerprints are
compared.

Defined cases: a null text is the empty text; a text without words has the
empty fingerprint, which is like (1.0) another empty one and unlike (0.0) any
other; a text of fewer than five words is a single shingle.  Rows of equal
``doc_id`` are ordered by text; null ids come first.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SHINGLE, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probe(attempt: int, bins: int) -> np.ndarray:
    seed = (attempt + 1) * T.BASE & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        return (T.mix(np.arange(bins, dtype=T.U64) + T.U64(seed)) & T.U64(bins - 1)).astype(np.int64)


def signatures(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE, bins: int = BINS,
               bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of each text's bins (texts x bins, uint8), and which texts have any shingle."""
    words, _, _, first = T.word_hashes(raw, off)
    h, owner = T.shingle_hashes(words, first, shingle)
    n, shift = len(off) - 1, T.U64(64 - int(bins).bit_length() + 1)
    table = np.full(n * bins, _EMPTY, T.U64)
    np.minimum.at(table, owner * bins + (h >> shift).astype(np.int64), h & ((T.U64(1) << shift) - T.U64(1)))
    table = table.reshape(n, bins)
    filled = table != _EMPTY
    some = filled.any(axis=1)
    rows, cols = np.nonzero(~filled & some[:, None])
    out, attempt = table.copy(), 0
    single = np.flatnonzero(filled.sum(axis=1) == 1)
    if len(single):  # every probe sequence ends in the one value there is
        out[single] = table[single].min(axis=1)[:, None]
        keep = ~np.isin(rows, single)
        rows, cols = rows[keep], cols[keep]
    while len(rows):
        to = _probe(attempt, bins)[cols]
        hit = filled[rows, to]
        out[rows[hit], cols[hit]] = table[rows[hit], to[hit]]
        rows, cols, attempt = rows[~hit], cols[~hit], attempt + 1
    return (out & T.U64((1 << bits) - 1)).astype(np.uint8), some


def pack(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Values of ``bits`` (1, 2, 4 or 8) bits, packed into bytes row by row."""
    per = 8 // bits
    parts = values.reshape(len(values), -1, per)
    out = np.zeros(parts.shape[:2], np.uint8)
    for i in range(per):
        out |= parts[:, :, i] << np.uint8(bits * (per - 1 - i))
    return out


def unpack(packed: np.ndarray, bits: int = BITS) -> np.ndarray:
    per = 8 // bits
    parts = [(packed >> np.uint8(bits * (per - 1 - i))) & np.uint8((1 << bits) - 1) for i in range(per)]
    return np.stack(parts, axis=2).reshape(len(packed), -1)


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of rows of bin values, corrected for agreement by chance."""
    chance = 2.0 ** -bits
    same = (a == b).mean(axis=1) if a.size else np.zeros(len(a))
    est = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, est, (~some_a & ~some_b).astype(float))


def _hex(values: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    packed = pack(values, bits)
    return [packed[i].tobytes().hex() if some[i] else "" for i in range(len(packed))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id, fingerprint as lowercase hex) of every text; no shuffle."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                raw, off = T.string_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_hex(*signatures(raw, off, shingle, bins, bits), bits), pa.string())],
                    names=[id_col, "fingerprint"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt into ``parts`` consecutive id ranges, each range ending in a copy of the row after it.

    Columns: range, copy (1 for the added row), doc_id, text.  Only the range
    borders (``parts`` ids) reach the driver.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = src.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)
                     .alias("c")).first().c if parts > 1 else []
    cuts = np.array(sorted(set(cut or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), 0, at).astype(np.int32))

    ids = src.select("doc_id", range_of("doc_id").alias("range"))
    firsts = [(r["range"], r.first) for r in ids.groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"].alias("first"))
        .orderBy("range").collect()]
    to = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}

    @F.pandas_udf("int")
    def copy_to(x: pd.Series) -> pd.Series:
        return pd.Series([to.get(None if pd.isna(v) else int(v), -1) for v in x], dtype="int32")

    own = F.struct(F.col("range"), F.lit(0).alias("copy"))
    dealt = (src.withColumn("range", range_of("doc_id")).withColumn("also", copy_to("doc_id"))
             .withColumn("at", F.explode(F.when(F.col("also") >= 0, F.array(
                 own, F.struct(F.col("also").alias("range"), F.lit(1).alias("copy")))).otherwise(F.array(own)))))
    return (dealt.select("at.range", "at.copy", "doc_id", "text").repartition(parts, "range")
            .sortWithinPartitions("range", "copy", "doc_id", "text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None   # the last row seen: range, copy, id, text, bins, some
    for batch in batches:
        for part in T.slices(batch, "text"):
            raw, off = T.string_bytes(part.column("text"))
            bins, some = signatures(raw, off)
            rows = list(zip(part.column("range").to_pylist(), part.column("copy").to_pylist(),
                            part.column("doc_id").to_pylist(),
                            (t or "" for t in part.column("text").to_pylist()), bins, some, strict=True))
            line = ([held] if held else []) + rows
            held = line[-1]
            use = [(a, b) for a, b in zip(line, line[1:], strict=False) if a[0] == b[0] and not a[1]]
            if not use:
                continue
            edited = [edit(a[3], b[3]).encode() for a, b in use]
            data = pa.array(edited, pa.large_binary())
            ebins, esome = signatures(*T.string_bytes(data))
            one, two = np.array([a[4] for a, _ in use]), np.array([b[4] for _, b in use])
            some1, some2 = np.array([a[5] for a, _ in use]), np.array([b[5] for _, b in use])
            cols = [[a[2] for a, _ in use], [len(a[3]) for a, _ in use],
                    [hashlib.sha256(e).hexdigest() for e in edited], _hex(one, some1), _hex(ebins, esome),
                    likeness(one, ebins, some1, esome), likeness(one, two, some1, some2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def edited_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text, its edited text, and their likeness to it and to the next document's.

    The text is shuffled once, into id ranges; a range holds a copy of the first
    row of the range after it, the last range that of the first.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return with_following(docs, parts).mapInArrow(
        _pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
