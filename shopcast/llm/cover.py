"""Substring dedup by difference-cover anchors.

Words are hashed, and windows of ``ANCHOR`` words are looked at only where their
position modulo ``PERIOD`` lies in a difference cover.  For any two positions
some shift below the period brings both into the cover, so two equal runs of
``WINDOW`` = ANCHOR + PERIOD - 1 words share an anchor at the same shift.  An
exchange of distinct anchor hashes between chunks tells which occur in two
documents; those are extended to the windows of ``WINDOW`` words around them,
whose 96-bit hashes are exchanged with the smallest document id that holds
them.  A window whose sequence starts in a document of a smaller id is removed.

Defined cases: a null text has no words; null ids come after all others (rows
of equal or null id never remove from each other); a text shorter than a window
keeps all its words; repeated rows of one id are judged alike.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from . import text as T
from .tables import written

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7     # {0, 1, 3} is a perfect difference set modulo 7
WINDOW = ANCHOR + PERIOD - 1
_BASE2 = 0xC2B2AE3D27D4EB4F
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _runs(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word index) of every run of k words inside a text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _run_hashes(words: np.ndarray, at: np.ndarray, k: int, base: int) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    up, down = T.powers(len(words) + 1, base)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return T.mix((sums[at + k] - sums[at]) * down[at])


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(int(C.LAST_ID)).to_numpy()


def _anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word index, hash) of the anchors: runs at cover positions."""
    owner, at = _runs(words, first, ANCHOR)
    keep = _IN_COVER[(at - first[:-1][owner]) % PERIOD]
    owner, at = owner[keep], at[keep]
    h = _run_hashes(words, at, ANCHOR, T.BASE)
    return owner, at, C.from_leading(C.leading(h).ravel())


def _send_anchors(chunk: int, data: pa.Scalar, parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct anchors, each with whether two ids of the chunk hold it."""
    table = C.from_ipc(data)
    words, _, _, first = T.word_hashes(*T.string_bytes(table.column("raw")))
    owner, _, h = _anchors(words, first)
    keys, inverse = np.unique(h, return_inverse=True)
    ids = _ids(table)[owner]
    low, high = np.full(len(keys), C.LAST_ID), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, ids)
    np.maximum.at(high, inverse, ids)
    yield from C.blobs(chunk, keys, [C.leading(keys), (low != high).astype(np.uint8)], parts)


def _answer_anchors(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    keys = C.from_leading(np.concatenate([r[0] for r in rows]))
    group, n = C.group_ids(keys)
    shared = (np.bincount(group, minlength=n) > 1) | (np.bincount(group, np.concatenate([r[1] for r in rows]), n) > 0)
    return C.split_like(shared[group], rows, C.KEY_BYTES)


def _result(ids: list, n_words: list, removed: list, kept: list, chunk: tuple[int, bytes] | None = None) -> pa.RecordBatch:
    """Finished rows, and the chunk of those that are not."""
    n = len(ids) + (chunk is not None)
    pad = [None] * (chunk is not None)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids + pad, pa.int64()), pa.array(n_words + pad, pa.int64()), pa.array(removed + pad, pa.int64()),
         pa.array(kept + pad, pa.string()), pa.array([None] * (n - len(pad)) + [chunk[0]] * len(pad), pa.int64()) if chunk else pa.nulls(n, pa.int64()),
         pa.array([None] * (n - len(pad)) + [chunk[1]] * len(pad), pa.binary()) if chunk else pa.nulls(n, pa.binary())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "chunk", "data"])


_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, chunk long, data binary"


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])).hexdigest()


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without a shared anchor are finished; the others go on with their candidate windows."""
    chunks = C.Chunks()
    for batch in batches:
        for data, reply in zip(batch.column("data"), batch.column("reply"), strict=True):
            table = C.from_ipc(data)
            raw, off = T.string_bytes(table.column("raw"))
            words, _, _, first = T.word_hashes(raw, off)
            owner, at, h = _anchors(words, first)
            _, inverse = np.unique(h, return_inverse=True)
            hit = at[C.reply_bytes(reply)[inverse] > 0] if len(h) else at
            # a window that starts up to ANCHOR - 1 words before a shared anchor holds it whole
            mark = np.zeros(len(words) + PERIOD + 1, np.int32)
            np.add.at(mark, np.maximum(hit - PERIOD + 1, 0), 1)
            np.add.at(mark, hit + 1, -1)
            w_owner, w_at = _runs(words, first, WINDOW)
            some = np.cumsum(mark)[w_at] > 0
            w_owner, w_at = w_owner[some], w_at[some]
            open_ = np.bincount(w_owner, minlength=len(off) - 1) > 0
            ids, texts, count = table.column("doc_id").to_pylist(), table.column("raw"), np.diff(first)
            done = np.flatnonzero(~open_).tolist()
            rest = None
            if open_.any():
                starts = np.split(w_at - first[:-1][w_owner], np.cumsum(np.bincount(w_owner, minlength=len(off) - 1))[:-1])
                keep = np.flatnonzero(open_)
                rest = chunks.row(table.take(pa.array(keep)).append_column(
                    "windows", pa.array([starts[i].astype(np.int32).tobytes() for i in keep], pa.binary())))
            yield _result([ids[i] for i in done], count[done].tolist(), [0] * len(done),
                          [hashlib.sha256(b" ".join(texts[i].as_py().split())).hexdigest() for i in done], rest)


def _windows(table: pa.Table) -> tuple:
    """Words of a chunk and its candidate windows as (text, word index, two hashes)."""
    raw, off = T.string_bytes(table.column("raw"))
    words, starts, ends, first = T.word_hashes(raw, off)
    lists = [np.frombuffer(w.as_buffer(), np.int32) for w in table.column("windows")]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = first[owner] + (np.concatenate(lists) if lists else np.zeros(0, np.int64))
    h1 = _run_hashes(words, at, WINDOW, T.BASE)
    h2 = (_run_hashes(words, at, WINDOW, _BASE2) >> np.uint64(32)).astype(np.uint32)
    return raw, starts, ends, first, owner, at, h1, h2


def _distinct_windows(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each distinct window, ascending: hashes and smallest id; and the number of each window's."""
    group, n = C.group_ids(h1, h2)
    low = np.full(n, C.LAST_ID)
    np.minimum.at(low, group, ids)
    u1, u2 = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    u1[group], u2[group] = h1, h2
    return u1, u2, low, group


def _send_windows(chunk: int, data: pa.Scalar, parts: int) -> Iterator[pa.RecordBatch]:
    table = C.from_ipc(data)
    *_, owner, _, h1, h2 = _windows(table)
    u1, u2, low, _ = _distinct_windows(h1, h2, _ids(table)[owner])
    yield from C.blobs(chunk, u1, [u1, u2, low], parts)


def _answer_windows(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    h1, h2, low = (np.concatenate([r[i].view(kind) for r in rows]) for i, kind in enumerate((np.uint64, np.uint32, np.int64)))
    group, n = C.group_ids(h1, h2)
    least = np.full(n, C.LAST_ID)
    np.minimum.at(least, group, low)
    return C.split_like(least[group] < low, rows, 8)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, reply in zip(batch.column("data"), batch.column("reply"), strict=True):
            table = C.from_ipc(data)
            raw, starts, ends, first, owner, at, h1, h2 = _windows(table)
            ids = _ids(table)[owner]
            _, _, low, group = _distinct_windows(h1, h2, ids)
            gone = at[(C.reply_bytes(reply)[group] > 0) | (ids > low[group])]
            mark = np.zeros(len(starts) + WINDOW + 1, np.int32)
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + WINDOW, -1)
            keep = np.cumsum(mark)[:len(starts)] == 0
            data_bytes, n = raw.tobytes(), np.diff(first)
            left = [int(keep[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield _result(table.column("doc_id").to_pylist(), n.tolist(), (n - left).tolist(),
                          [_kept(data_bytes, starts[a:b], ends[a:b], keep[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])


def repeated_windows_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    packed = C.pack(docs)
    parts = C.parts_for(packed)
    anchors = C.exchange(packed, lambda c, d: _send_anchors(c, d, parts), _answer_anchors, 2, parts)
    first = written(C.with_replies(packed, anchors, "cover-anchors").mapInArrow(_extend, _SCHEMA), "cover-first")
    rest = first.where("data IS NOT NULL").select("chunk", "data")
    windows = C.exchange(rest, lambda c, d: _send_windows(c, d, parts), _answer_windows, 3, parts)
    last = C.with_replies(rest, windows, "cover-windows").mapInArrow(_remove, _SCHEMA)
    return first.where("data IS NULL").unionByName(last).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i FROM windows JOIN least USING (s) WHERE first < doc_id), (SELECT unnest(range(0, 13)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""
