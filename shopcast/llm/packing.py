"""Order-preserving packing of tokenised documents into sequences, by dynamic programming over window cuts.

The tokens of a partition's documents, in the table's order, form blocks of whole
documents.  A block is cut into windows of at most ``WINDOW`` tokens.  The cost
of a set of cuts is the padding (to ``WINDOW``, none for a length that is a power
of two and at least ``SHORTEST``), a penalty for each cut inside a document (``SENTENCE`` at the end of a
sentence or line, ``INSIDE`` anywhere else) and one for each window; cuts between
documents are free.  Cuts inside a sentence are only considered where a full window
from another cut ends without a better place in its last ``INSIDE - SENTENCE``
tokens.  The best
window that ends at a cut is the front of a monotone queue over cost plus place
of the cuts up to ``WINDOW`` tokens back; the powers of two are looked up.

No shuffle: a block is at most ``BLOCK`` tokens and the document that fills it.
Reruns over the same files and splits give the same sequences.

Defined cases: a null text is the empty text, which is the closing id alone.
Repeated rows are documents of their own.  A very long text is one block and is
cut like any other.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW = 1024
SENTENCE, INSIDE, EACH = 8, 24, 1
SHORTEST = 64                   # shorter windows are counted as padded, powers of two or not
BLOCK = 1 << 18                 # tokens after which a block is closed
CLOSING = b"\0\0\0\0"           # id 0 ends a document
CACHE_BYTES = 96 << 20          # pieces and their ids remembered by a worker; when full, only the last slice's stay
SLICE = 16 << 20                # bytes of text whose pieces are looked up together, each distinct one once
GROUP = 400                     # pieces encoded in one text
SPACE, LEAD = 0x20, " x"        # pieces that begin with a mark are encoded behind LEAD
LETTER, MARK, SEEN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
SEEN[33:127] = SEEN[128:] = True                # no white space, unless the character has several bytes


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the character of three bytes can be white space (a few that are not are taken for it)."""
    return ((a == 0xE2) & (b >> 1 == 0x40) & ((c < 0x90) | (c > 0xA7)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
            | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def _seen_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space."""
    c = raw[at - 1]
    out, wide = SEEN[c], np.flatnonzero(c > 127)
    a, b, c = raw[at[wide] - 3], raw[at[wide] - 2], c[wide]
    out[wide] = ~((b == 0xC2) & (c <= 0xA0) | _white(a, b, c))
    return out


def _seen_after(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is surely no white space."""
    a = raw[at]
    out, wide = SEEN[a], np.flatnonzero(a > 127)
    a, b, c = a[wide], raw[at[wide] + 1], raw[np.minimum(at[wide] + 2, len(raw) - 1)]
    out[wide] = ~((a == 0xC2) & (b <= 0xA0) | _white(a, b, c))
    return out


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; all of them are edges of pre-tokens.

    A piece begins with a text, with a single space between two characters that are
    no white space, and with an ASCII mark after a Latin letter.
    """
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    cut = edge[:-1].copy()
    gap = np.flatnonzero(raw == SPACE)
    gap = gap[~(edge[gap] | edge[gap + 1])]
    gap = gap[_seen_before(raw, gap)]
    cut[gap[_seen_after(raw, gap + 1)]] = True
    mark = np.flatnonzero(MARK[raw])
    mark = mark[~edge[mark]]
    c, b = raw[mark - 1], raw[mark - 2]             # U+00C0 to U+023F are letters but for two signs
    cut[mark[LETTER[c] | (c > 127) & (b >= 0xC3) & (b <= 0xC8) & ~((b == 0xC3) & ((c == 0x97) | (c == 0xB7)))]] = True
    return np.flatnonzero(cut)


def _binary(off: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(data)])


class Encoder:
    """Ids of texts by a byte-level ``tokenizers`` model.

    Texts are cut into pieces at edges of pre-tokens; the distinct pieces of a call
    are encoded once each, many in one text, and remembered.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        self.model.encode_special_tokens = True     # their strings in a text are ordinary text
        words = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size())]
        self.spaced = np.array([w.startswith("Ġ") for w in words])                     # begins with a space
        self.opens = np.array([w[:1] in {"Ġ", "Ċ", "ĉ", "č"} for w in words])          # begins with white space
        self.stops = np.array([w.rstrip("\"')]")[-1:] in {".", "!", "?"} for w in words])
        self.lines = np.array(["Ċ" in w for w in words])
        self.lead = len(self._ids([LEAD])[0]) // 4
        self.known = self.known_ids = pa.array([], pa.large_binary())

    @property
    def heads(self) -> set[str]:
        """The remembered pieces that do not begin with a space."""
        return {w.decode() for w in self.known.to_pylist() if w[0] != SPACE}

    @property
    def parts(self) -> set[str]:
        """The remembered pieces after a space."""
        return {w[1:].decode() for w in self.known.to_pylist() if w[0] == SPACE}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: pa.Array, lead: str = "") -> pa.Array:
        """Ids of pieces that begin with their only space, or with a mark (behind ``lead``), and end in no white space."""
        if lead:
            words = pieces.to_pylist()
            texts = [lead + lead.join(w.decode() for w in words[i:i + GROUP]) for i in range(0, len(words), GROUP)]
        else:
            raw, off = T.string_bytes(pieces)
            at, data = [*off[:-1:GROUP].tolist(), len(raw)], raw.tobytes()
            texts = [data[a:b].decode() for a, b in zip(at, at[1:], strict=False)]
        ids = np.frombuffer(b"".join(self._ids(texts)), "<u4")
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(pieces):
            raise RuntimeError("the pieces of a text are not the model's")
        if lead:
            ids = np.delete(ids, (at[:, None] + np.arange(self.lead)).ravel())
            at = at - self.lead * np.arange(len(at))
        return _binary(4 * np.append(at, len(ids)), ids.tobytes())

    def _learn(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces."""
        raw, off = T.string_bytes(pieces)
        gap = np.flatnonzero(raw == SPACE)
        owner = np.searchsorted(off, gap, "right") - 1
        single = np.ones(len(pieces), bool)         # no space but the first byte, no white space at the end
        single[owner[gap > off[owner]]] = False
        single &= _seen_before(raw, off[1:])
        first = raw[off[:-1]]
        kind = np.where(single & (first == SPACE), 0, np.where(single & MARK[first], 1, 2))
        spaced, marked, rest = (pieces.take(pa.array(np.flatnonzero(kind == k))) for k in range(3))
        out = [self._together(spaced) if len(spaced) else spaced, self._together(marked, LEAD) if len(marked) else marked,
               pa.array(self._ids([w.decode() for w in rest.to_pylist()]) if len(rest) else [], pa.large_binary())]
        place = np.empty(len(kind), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(kind))
        return pa.concat_arrays(out).take(pa.array(place))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text (null: the empty text) as little-endian unsigned 32-bit integers."""
        raw, off = T.string_bytes(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        if not len(raw):
            return [b""] * (len(off) - 1)
        starts = piece_starts(raw, off)
        coded = _binary(np.append(starts, len(raw)), raw).dictionary_encode()
        pieces = coded.dictionary
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(at.is_null())
        fresh_ids = self._learn(fresh) if len(fresh) else fresh
        new = at.is_null().to_numpy(zero_copy_only=False)
        where = at.fill_null(0).to_numpy().astype(np.int64)
        where[new] = len(self.known) + np.arange(len(fresh))
        known, ids = pa.concat_arrays([self.known, fresh]), pa.concat_arrays([self.known_ids, fresh_ids])
        use = ids.take(pa.array(where))
        if known.nbytes + ids.nbytes > CACHE_BYTES:
            known, ids = pieces, use
        self.known, self.known_ids = known, ids
        data, edges = T.string_bytes(use.take(coded.indices))
        at, view = edges[np.searchsorted(starts, off)].tolist(), memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places after which a new sentence or line begins."""
        after = self.opens[ids[1:]] & self.stops[ids[:-1]] | self.lines[ids[:-1]]
        return np.flatnonzero(after) + 1


def window_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW, sentence: int = SENTENCE,
                inside: int = INSIDE, each: int = EACH, shortest: int = SHORTEST) -> list[int]:
    """The cheapest cuts of a block, the last one at ``places[-1]``, the block's end.

    ``places`` are the ascending ends of sentences and documents and
    ``penalties`` the cost of a cut there.
    """
    slack, last = inside - sentence, int(places[-1])
    upto = np.zeros(last + 1, np.int64)
    upto[places] = 1
    edge = upto.astype(bool)            # where a window can begin or end
    edge[0] = True
    np.cumsum(upto, out=upto)
    # a full window from an edge ends inside a sentence with no other end near: an edge, too
    to = np.arange(window, last)
    lacks = upto[to] == upto[np.maximum(to - slack - 1, 0)]
    for at in range(0, len(lacks), window):
        some = lacks[at:at + window]
        edge[at + window:at + window + len(some)] |= edge[at:at + len(some)] & some
    ends = np.flatnonzero(edge)[1:]
    more = np.full(last + 1, inside + each)
    more[places] = penalties + each
    reach = [1 << k for k in range(window.bit_length()) if shortest <= 1 << k < window]
    power = np.zeros(len(ends), bool)   # whether a window as long as a power of two can end here
    for n in reach:
        power |= (ends >= n) & edge[np.maximum(ends - n, 0)]
    # by place + window, so that places before the block read as out of reach
    far = 1 << 30
    cost, back = array("i", [far]) * (last + window + 1), array("i", [0]) * (last + 1)
    cost[window] = 0
    offsets = [window - n for n in reach]
    least_of, place_of = deque([0]), deque([0])     # of the cuts in reach: cost + place, and place; both ascending
    for here, extra, short in zip(ends.tolist(), more[ends].tolist(), power.tolist(), strict=True):
        floor = here - window
        while (start := place_of[0]) < floor:
            place_of.popleft()
            least_of.popleft()
        least = least_of[0] - floor
        if short:
            for offset in offsets:
                c = cost[here + offset]
                if c < least:
                    start, least = here + offset - window, c
        cost[here + window] = least = least + extra
        back[here] = start
        key = least + here
        while least_of and least_of[-1] >= key:
            least_of.pop()
            place_of.pop()
        least_of.append(key)
        place_of.append(here)
    cuts = [last]
    while back[cuts[-1]]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _pieces(names: pa.Array, ids: list[bytes], encoder: Encoder, first: int, window: int
            ) -> tuple[pa.RecordBatch, int]:
    """The pieces of one block, its sequences numbered from ``first``; and the number after the last."""
    raw = b"".join(ids)
    size = np.array([len(x) // 4 for x in ids], np.int64)
    ends = np.cumsum(size)
    tokens = np.frombuffer(raw, "<u4")
    kind = np.zeros(len(tokens) + 1, np.int8)
    kind[encoder.sentence_ends(tokens)] = 1
    kind[ends] = 2
    places = np.flatnonzero(kind)
    cuts = np.array(window_cuts(places, np.where(kind[places] == 1, SENTENCE, 0), window), np.int64)
    edges = np.union1d(cuts, ends)
    lo = np.concatenate(([0], edges[:-1]))
    doc, seq = np.searchsorted(ends, lo, "right"), np.searchsorted(cuts, lo, "right")
    view = memoryview(raw)
    crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(lo.tolist(), edges.tolist(), strict=True)]
    begin = np.concatenate(([0], cuts[:-1]))
    cols = [names.take(pa.array(doc)), pa.array(lo - (ends - size)[doc]), pa.array(edges - lo), pa.array(crc, pa.int64()),
            pa.array(size[doc]), pa.array(first + seq), pa.array(lo - begin[seq])]
    return pa.RecordBatch.from_arrays(cols, names=["doc", *COLUMNS]), first + len(cuts)


_encoders: dict[str, Encoder] = {}      # one per model and worker, kept between tasks


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, spec_file: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    ``spec_file`` is a ``tokenizers`` file with a byte-level model; its text (a few
    megabytes, whatever the corpus) is broadcast.
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    with open(spec_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one core a task
        encoder, following = None, TaskContext.get().partitionId() << 33
        names, ids, held = [], [], 0
        rename = lambda b: b.rename_columns([id_col, *COLUMNS])
        for batch in batches:
            if encoder is None:
                encoder = _encoders.get(spec.value) or _encoders.setdefault(spec.value, Encoder(spec.value))
            for part in T.slices(batch, "text", SLICE):
                coded = [x + CLOSING for x in encoder.encode(part.column("text"))]
                low = 0
                for i, x in enumerate(coded):
                    ids.append(x)
                    held += len(x) // 4
                    if held >= BLOCK:
                        names.append(part.column(0).slice(low, i + 1 - low))
                        block, following = _pieces(pa.concat_arrays(names), ids, encoder, following, window)
                        yield rename(block)
                        names, ids, held, low = [], [], 0, i + 1
                if low < len(coded):
                    names.append(part.column(0).slice(low))
        if ids:
            yield rename(_pieces(pa.concat_arrays(names), ids, encoder, following, window)[0])

    return src.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))
