"""Suffix dedup by a common-prefix-aware distributed merge sort.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere
else.  Every such string has one anchor, the position of the smallest hash of
``GRAM`` bytes among its first ``REACH`` positions; equal strings have their
anchors at the same offset, so it is enough to sort the suffixes at anchors.

1. Chunks exchange distinct hashes of the ``CERTAIN`` bytes that any string
   shares from its anchor on, to learn which suffixes have a like at all (the
   approximate distinguishing prefixes of string merge sort).
2. The others are sorted in each chunk into a run, equal ones once, front-coded:
   of each suffix only the bytes beyond its common prefix with the one before
   are sent.  Runs are dealt out by the hash of the certain prefix, as only
   suffixes that share it can be neighbours that matter; nothing of them passes
   through the driver.  A loser tree merges the runs of a part; it knows every head's common prefix with the last winner and compares
   characters only beyond it, where two heads tie.
3. Neighbours in the merged order that agree from the first to the last string
   of their anchors make all these strings repeats; an anchor whose neighbours
   share too little has none.  What is left (strings across the edge of a
   repeated passage) is checked exactly: an exchange of 96-bit hashes of those
   strings and of all that sorted beside them.

Suffixes whose certain prefix occurs more than ``CROWD`` times go straight to
step 3, whose hashes spread over all tasks, so no task holds a crowd.

Defined cases: a null text is the empty text; texts shorter than ``LENGTH`` keep
everything; repeated rows are different places; matches never cross documents.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import text as T
from .tables import written

LENGTH = 400
REACH, GRAM = 128, 16                    # REACH is a power of two and at most 256
CERTAIN = LENGTH - REACH + 1
CROWD = 65_536
_BASE2 = 0xC2B2AE3D27D4EB4F
YES, LOOK = 1, 2                         # of an anchor: all its strings are repeats; look at each of them


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start): which string starts belong to which anchor."""
    n = len(raw) - GRAM + 1
    count = np.maximum(np.diff(off) - LENGTH + 1, 0)
    none = np.zeros(0, np.int64)
    if n < REACH or not count.any():
        return none, none, none, none
    sums = T.prefix_sums(raw)
    _, down = T.powers(len(sums))
    best = T.mix((sums[GRAM:] - sums[:-GRAM]) * down[:n]) >> np.uint64(32) << np.uint64(32)
    best |= np.arange(n, dtype=np.uint64)     # ties go to the left
    span = 1
    while span < REACH:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    owner = np.repeat(np.arange(len(count)), count)
    start = off[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (owner[1:] != owner[:-1])) + 1))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    return owner[new], at[new], start[new], start[last]


def _certain(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """``anchors`` and the truncated hash of each one's certain prefix."""
    owner, at, lo, hi = anchors(raw, off)
    if not len(at):
        return owner, at, lo, hi, np.zeros(0, np.uint64)
    h = T.mix(T.range_hashes(T.prefix_sums(raw), at, at + CERTAIN))
    return owner, at, lo, hi, C.from_leading(C.leading(h).ravel())


def _send_certain(chunk: int, data: pa.Scalar, parts: int) -> Iterator[pa.RecordBatch]:
    *_, h = _certain(*T.string_bytes(C.from_ipc(data).column("raw")))
    keys, n = np.unique(h, return_counts=True)
    yield from C.blobs(chunk, keys, [C.leading(keys), np.minimum(n, 255).astype(np.uint8)], parts)


def _answer_certain(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """0: occurs once; 1: more often; 2: more than ``CROWD`` times."""
    group, n = C.group_ids(C.from_leading(np.concatenate([r[0] for r in rows])))
    total = np.bincount(group, np.concatenate([r[1] for r in rows]), n)
    return C.split_like(((total > 1) + (total > CROWD).astype(np.int64))[group], rows, C.KEY_BYTES)


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, chunk long, data binary"


def _result(rows: list[tuple], chunk: tuple[int, bytes] | None = None) -> pa.RecordBatch:
    rows = [(*r, None, None) for r in rows] + ([(None,) * 5 + chunk] if chunk else [])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "chunk", "data"])


def _with_anchors(table: pa.Table, owner: np.ndarray, columns: dict[str, np.ndarray], keep: np.ndarray) -> pa.Table:
    """The kept rows of a table (doc_id, raw), with the anchors' numbers as one binary a row and column."""
    cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=table.num_rows))))
    out = table.select(["doc_id", "raw"]).take(pa.array(keep))
    for name, v in columns.items():
        out = out.append_column(name, pa.array([v[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary()))
    return out


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts none of whose suffixes has a like are finished; the others go on with those that have."""
    chunks = C.Chunks()
    for batch in batches:
        for data, reply in zip(batch.column("data"), batch.column("reply"), strict=True):
            table = C.from_ipc(data)
            raw, off = T.string_bytes(table.column("raw"))
            owner, at, lo, hi, h = _certain(raw, off)
            code = C.reply_bytes(reply)[np.unique(h, return_inverse=True)[1]] if len(h) else np.zeros(0, np.uint8)
            some = code > 0
            owner, at, lo, hi, code = owner[some], at[some], lo[some], hi[some], code[some]
            ids, texts, base = table.column("doc_id").to_pylist(), table.column("raw"), off[:-1][owner]
            open_ = np.bincount(owner, minlength=len(ids)) > 0
            columns = {"at": (at - base).astype(np.int64), "lo": (lo - base).astype(np.int64),
                       "hi": (hi - base).astype(np.int64), "state": np.where(code == 2, LOOK, 0).astype(np.uint8)}
            rest = chunks.row(_with_anchors(table, owner, columns, np.flatnonzero(open_))) if open_.any() else None
            yield _result([(ids[i], int(off[i + 1] - off[i]), 0, 0, hashlib.sha256(texts[i].as_py()).hexdigest())
                           for i in np.flatnonzero(~open_)], rest)


class _Open:
    """The anchors of a chunk that goes on, in bytes of the whole chunk."""

    def __init__(self, data: pa.Scalar):
        self.table = C.from_ipc(data)
        self.raw, self.off = T.string_bytes(self.table.column("raw"))
        lists = {c: [np.frombuffer(x.as_buffer(), np.uint8 if c == "state" else np.int64) for x in self.table.column(c)]
                 for c in ("at", "lo", "hi", "state")}
        self.owner = np.repeat(np.arange(len(lists["at"])), [len(x) for x in lists["at"]])
        base = self.off[:-1][self.owner]
        join = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in lists.items()}
        self.at, self.lo, self.hi, self.state = join["at"] + base, join["lo"] + base, join["hi"] + base, join["state"]
        self.sums = T.prefix_sums(self.raw)

    def run(self, parts: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The run of suffixes that are not in a crowd, equal ones once, sorted within each part.

        (anchors, place of each in the run; of the run: suffixes, bytes to the left
        that its strings take, their hash, anchors, parts).
        """
        which = np.flatnonzero(self.state == 0)
        at, end = self.at[which], np.minimum(self.at[which] + LENGTH, self.off[1:][self.owner[which]])
        left = at - self.lo[which]
        left_hash = T.mix(T.range_hashes(self.sums, self.lo[which], at))
        right_hash = T.mix(T.range_hashes(self.sums, at, end) + (end - at).astype(np.uint64))
        group, n = C.group_ids(right_hash, left_hash, left)
        one = np.zeros(n, np.int64)
        one[group[::-1]] = np.arange(len(group))[::-1]
        data = self.raw.tobytes()
        strings = [data[a:b] for a, b in zip(at[one].tolist(), end[one].tolist(), strict=True)]
        l, h = left[one].tolist(), left_hash[one].tolist()
        deal = (T.mix(T.range_hashes(self.sums, at[one], at[one] + CERTAIN)) % np.uint64(parts)).astype(np.int64)
        d = deal.tolist()
        order = sorted(range(n), key=lambda i: (d[i], strings[i], l[i], h[i]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        one = one[order]
        return which, place[group], [strings[i] for i in order], left[one], left_hash[one], which[one], deal[order]


def _common(strings: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before (0 for the first)."""
    return np.array([0] + [common(a, b, 0) for a, b in zip(strings, strings[1:], strict=False)], np.uint16)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, ``known`` bytes of which need no look."""
    most = min(len(a), len(b))
    while known < most:
        x, y = a[known:known + 64], b[known:known + 64]
        if x != y:
            n = min(len(x), len(y))
            diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + (n if not diff else n - (diff.bit_length() + 7) // 8)
        known += len(x)
    return most


def _send_run(chunk: int, data: pa.Scalar, parts: int) -> Iterator[pa.RecordBatch]:
    chunk_data = _Open(data)
    which, place, strings, left, left_hash, one, deal = chunk_data.run(parts)
    if not strings:
        return
    twice = (np.bincount(place, minlength=len(strings)) > 1).astype(np.uint8)
    last = (chunk_data.at[one] - chunk_data.hi[one]).astype(np.uint8)
    shared = _common(strings)
    cuts = [0, *(np.flatnonzero(np.diff(deal)) + 1).tolist(), len(strings)]
    rows = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        h = shared[lo:hi].copy()
        h[0] = 0
        rest = b"".join(s[k:] for s, k in zip(strings[lo:hi], h.tolist(), strict=True))
        rows.append((int(deal[lo]), chunk, h.tobytes(), np.array([len(s) for s in strings[lo:hi]], np.uint16).tobytes(),
                     pa.compress(rest, "zstd", asbytes=True) if rest else b"", left[lo:hi].astype(np.uint8).tobytes(),
                     last[lo:hi].tobytes(), twice[lo:hi].tobytes(), left_hash[lo:hi].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.binary()) for i in range(9)],
                                     names=["part", "chunk", *(f"v{i}" for i in range(7))])


class _Run:
    """Reads one front-coded run; ``head`` is its current suffix."""

    def __init__(self, columns: list[np.ndarray]):
        self.shared = columns[0].view(np.uint16).tolist()
        self.length = columns[1].view(np.uint16).tolist()
        size = sum(self.length) - sum(self.shared)
        self.rest = pa.decompress(pa.py_buffer(columns[2].tobytes()), size, "zstd", asbytes=True) if size else b""
        self.left, self.last, self.twice = columns[3].tolist(), columns[4].tolist(), columns[5].tolist()
        self.hash = columns[6].view(np.uint64).tolist()
        self.at, self.read, self.head = -1, 0, b""

    def advance(self) -> int:
        """Go to the next suffix; its common prefix with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return -1
        k = self.shared[self.at]
        to = self.read + self.length[self.at] - k
        self.head = self.head[:k] + self.rest[self.read:to]
        self.read = to
        return k


def merged(runs: list[_Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the one before) of all suffixes in order, by a loser tree.

    ``known[r]`` is the common prefix of run r's head with the winner it last lost
    to; the head with the longer one is the smaller, and only ties are compared,
    from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [r.advance() for r in runs] + [-1] * (size - len(runs))
    losers = [0] * size

    def play(a: int, ka: int, b: int, kb: int) -> tuple[int, int, int]:
        """(winner, its known prefix, loser); sets what the loser knows."""
        if ka != kb:
            return (a, ka, b) if ka > kb else (b, kb, a)
        if ka < 0:
            return a, ka, b
        x, y = runs[a], runs[b]
        k = common(x.head, y.head, ka)
        if k == len(x.head) or k == len(y.head):
            first = (len(x.head), x.left[x.at], x.hash[x.at]) <= (len(y.head), y.left[y.at], y.hash[y.at])
        else:
            first = x.head[k] < y.head[k]
        if first:
            known[b] = k
            return a, ka, b
        known[a] = k
        return b, kb, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        win, _, losers[node] = play(a, known[a], b, known[b])
        return win

    win = build(1)
    while known[win] >= 0:
        run = runs[win]
        yield win, run.at, known[win]
        now, k = win, run.advance()
        known[now] = k
        node = (win + size) >> 1
        while node:
            other = losers[node]
            now, k, losers[node] = play(now, k, other, known[other])
            node >>= 1
        win = now
        known[win] = k


def _answer_runs(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each suffix ``YES`` and ``LOOK`` from its neighbours in the merged order."""
    runs = [_Run(r) for r in rows]
    out = [np.zeros(len(r.shared), np.uint8) for r in runs]
    group: list[tuple[int, int]] = []      # suffixes that share the certain prefix
    look, before = False, None             # whether one of them is not settled

    def settle(suffix: tuple[int, int], close: bool) -> bool:
        """Whether a suffix with (``close``) a neighbour near enough for some string is left open."""
        r, i = suffix
        if runs[r].twice[i]:
            out[r][i] |= YES
        return close and not out[r][i] & YES

    def end_group() -> None:
        if look:
            for r, i in group:
                out[r][i] |= LOOK

    close = False                          # of ``before``: a neighbour shares enough for its longest left part
    for r, i, k in merged(runs):
        run = runs[r]
        mine = k >= LENGTH - run.left[i]
        if before is not None:
            q, j = before
            b = runs[q]
            same = b.left[j] == run.left[i] and b.hash[j] == run.hash[i]
            if same and k >= LENGTH - b.last[j]:
                out[q][j] |= YES
            if same and k >= LENGTH - run.last[i]:
                out[r][i] |= YES
            look |= settle(before, close or k >= LENGTH - b.left[j])
        if k < CERTAIN or len(group) >= CROWD:   # a cut crowd is looked at whole
            look |= len(group) >= CROWD
            end_group()
            look = k >= CERTAIN
            group = []
        group.append((r, i))
        before, close = (r, i), mine
    if before is not None:
        look |= settle(before, close)
    end_group()
    return out


def _settle(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the state of every anchor after the merge."""
    for batch in batches:
        for chunk, data, reply in zip(batch.column("chunk"), batch.column("data"), batch.column("reply"), strict=True):
            c = _Open(data)
            which, place, strings, *_ = c.run(parts)
            state = c.state.copy()
            if strings:
                state[which] = C.reply_bytes(reply)[place]
            base = c.off[:-1][c.owner]
            table = _with_anchors(c.table, c.owner, {"at": c.at - base, "lo": c.lo - base, "hi": c.hi - base, "state": state},
                                  np.arange(c.table.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([C.to_ipc(table)], pa.binary())], names=["chunk", "data"])


def _looked_at(c: _Open) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hashes of each string to look at."""
    sel = c.state & LOOK > 0
    lo, n = c.lo[sel], (c.hi - c.lo + 1)[sel]
    start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h1 = T.mix(T.range_hashes(c.sums, start, start + LENGTH))
    h2 = T.mix(T.range_hashes(T.prefix_sums(c.raw, _BASE2), start, start + LENGTH, _BASE2)) >> np.uint64(32)
    return start, h1, h2.astype(np.uint32)


def _send_strings(chunk: int, data: pa.Scalar, parts: int) -> Iterator[pa.RecordBatch]:
    _, h1, h2 = _looked_at(_Open(data))
    group, n = C.group_ids(h1, h2)
    u1, u2 = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    u1[group], u2[group] = h1, h2
    yield from C.blobs(chunk, u1, [u1, u2, (np.bincount(group, minlength=n) > 1).astype(np.uint8)], parts)


def _answer_strings(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    h1, h2 = (np.concatenate([r[i].view(kind) for r in rows]) for i, kind in enumerate((np.uint64, np.uint32)))
    group, n = C.group_ids(h1, h2)
    again = (np.bincount(group, minlength=n) > 1) | (np.bincount(group, np.concatenate([r[2] for r in rows]), n) > 0)
    return C.split_like(again[group], rows, 8)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, reply in zip(batch.column("data"), batch.column("reply"), strict=True):
            c = _Open(data)
            start, h1, h2 = _looked_at(c)
            group, _ = C.group_ids(h1, h2)
            start = start[C.reply_bytes(reply)[group] > 0] if len(start) else start
            mark = np.zeros(len(c.raw) + LENGTH + 1, np.int32)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + LENGTH, -1)
            yes = c.state & YES > 0
            np.add.at(mark, c.lo[yes], 1)
            np.add.at(mark, c.hi[yes] + LENGTH, -1)
            gone, rows = np.cumsum(mark)[:len(c.raw)] > 0, []
            for i, doc_id in enumerate(c.table.column("doc_id").to_pylist()):
                g, own = gone[c.off[i]:c.off[i + 1]], c.raw[c.off[i]:c.off[i + 1]]
                spans = int((g[1:] & ~g[:-1]).sum() + g[:1].sum())
                rows.append((doc_id, len(own), int(g.sum()), spans, hashlib.sha256(own[~g].tobytes()).hexdigest()))
            yield _result(rows)


def repeated_bytes_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    packed = C.pack(docs)
    parts = C.parts_for(packed)
    certain = C.exchange(packed, lambda c, d: _send_certain(c, d, parts), _answer_certain, 2, parts)
    first = written(C.with_replies(packed, certain, "suffix-certain").mapInArrow(_filter, _SCHEMA), "suffix-first")
    rest = first.where("data IS NOT NULL").select("chunk", "data")
    order = C.exchange(rest, lambda c, d: _send_run(c, d, parts), _answer_runs, 7, parts)
    settled = written(C.with_replies(rest, order, "suffix-order").mapInArrow(lambda b: _settle(b, parts), "chunk long, data binary"), "suffix-settled")
    strings = C.exchange(settled, lambda c, d: _send_strings(c, d, parts), _answer_strings, 3, parts)
    last = C.with_replies(settled, strings, "suffix-strings").mapInArrow(_remove, _SCHEMA)
    return first.where("data IS NULL").unionByName(last).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
