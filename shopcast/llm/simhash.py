"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks; two fingerprints that differ in
at most four bits differ in at most one bit of some block.  The anchors of a
block are the words of a covering code: a Hamming code of length 15 next to the
block's other bits as they are, so every block value has an anchor within one
bit.  A fingerprint is at home at its nearest anchor and is copied to every
anchor within covering radius plus threshold (two bits); at each anchor the
fingerprints at home are compared with all that are copied there.  Only edges
of a spanning forest leave an anchor, never all pairs.

Equal fingerprints are one row from the start.  An anchor that draws many
fingerprints is cut into cells of bounded size, each home part against each
copied part.  Components come from alternating large-star and small-star steps.

Defined cases: a null text or one without words has fingerprint zero, linked
like any other; fewer words than a shingle are one shingle, the whole
sequence.  Repeated rows share a component; a component whose ids are all null
has a null id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .tables import written

SHINGLE, DISTANCE, SEED = 4, 4, 42
BLOCKS = ((0, 22), (22, 21), (43, 21))   # first bit and width; DISTANCE // 3 = 1 differing bit in one of them
HAMMING = 15                             # code bits of a block; the block's other bits stand as they are
RADIUS = 1
HOME = 1 << 31                           # bit of an anchor key: the fingerprint is at home there
CELL = 16_384                            # most rows of either side in one comparison
PART_ROWS = 50_000                       # fingerprints for each part of the anchors
HELD_ROWS = 1 << 22                      # rows of a part after which crowded anchors are looked for


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; zero without words."""
    import xxhash
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - k + 1].tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big")


def text_hash(text_col: str = "text") -> Column:
    """SHA-256 of a text (32 bytes); no bytes for a null text."""
    return F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256)), F.lit(b""))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                 hashed: bool = False) -> DataFrame:
    """(id, fp as signed long; ``hashed``: and the text's hash) of every text; no shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *([text_hash(text_col).alias("hash")] if hashed else []))
    lower = bytes(T.LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = [fingerprint((t.as_py() or b"").translate(lower).split(), shingle) for t in texts]
            more = [batch.column("hash")] if hashed else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), *more],
                names=["doc_id", "fp", "hash"][:2 + len(more)])

    return src.mapInArrow(run, "doc_id long, fp long" + (", hash binary" if hashed else ""))


def _hamming_words() -> np.ndarray:
    """For each 15-bit value the nearest word of the Hamming code (syndrome = xor of the set positions)."""
    v = np.arange(1 << HAMMING)
    syndrome = np.zeros_like(v)
    for i in range(HAMMING):
        syndrome ^= np.where(v >> i & 1, i + 1, 0)
    return np.where(syndrome == 0, v, v ^ (1 << np.maximum(syndrome - 1, 0)))


def _flips(width: int, most: int) -> list[tuple[int, int]]:
    """(mask, bits set) of every way to change up to ``most`` (two) of ``width`` bits."""
    out = [(0, 0)]
    if most > 0:
        out += [(1 << i, 1) for i in range(width)]
    if most > 1:
        out += [(1 << i | 1 << j, 2) for i in range(width) for j in range(i)]
    return out


def _copies(value: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within ``reach`` (two) bits of each block value: row numbers and anchors, each once."""
    nearest = _hamming_words()
    low, high = value & ((1 << HAMMING) - 1), value >> HAMMING
    rows, anchors = [], []
    for mask, used in _flips(HAMMING, reach):
        hit = np.flatnonzero(nearest[low ^ mask] == low ^ mask)
        for other, more in _flips(width - HAMMING, reach):
            if used + more <= reach and len(hit):
                rows.append(hit)
                anchors.append((high[hit] ^ other) << HAMMING | low[hit] ^ mask)
    return np.concatenate(rows), np.concatenate(anchors)


def anchored(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, fingerprint) rows of distinct fingerprints over all blocks; ``HOME`` marks the home anchor."""
    nearest = _hamming_words()
    keys, values = [], []
    for b, (first, width) in enumerate(BLOCKS):
        value = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        rows, anchors = _copies(value, width, RADIUS + DISTANCE // len(BLOCKS))
        home = value >> HAMMING << HAMMING | nearest[value & ((1 << HAMMING) - 1)]
        keys.append((b << 24 | anchors | np.where(home[rows] == anchors, HOME, 0)).astype(np.uint32))
        values.append(fps[rows])
    return np.concatenate(keys), np.concatenate(values)


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Anchor rows as one packed row for each part of the anchors and 16,384 fingerprints."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16_384):
            key, fp = anchored(batch.column("fp").slice(at, 16_384).to_numpy().view(np.uint64))
            part = (T.mix((key & np.uint32(HOME - 1)).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, fp, part = key[order], fp[order], part[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[np.concatenate(([0], cut))]), pa.array([k.tobytes() for k in np.split(key, cut)], pa.binary()),
                 pa.array([f.tobytes() for f in np.split(fp, cut)], pa.binary())], names=["part", "keys", "fps"])


def forest(home: np.ndarray, copied: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever pairs of one home and one copied fingerprint link (home is within copied)."""
    group = np.arange(len(copied))
    a, b = [], []
    for x in home:
        found = group[np.bitwise_count(copied ^ x) <= distance]
        low = found.min()
        if len(found) > 1 and (found != low).any():
            others = np.unique(found[found != low])
            group[np.isin(group, others)] = low
            a.append(copied[others])
            b.append(np.full(len(others), copied[low]))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


class _Part:
    """The rows of one part of the anchors; those of crowded anchors leave as they come."""

    def __init__(self):
        self.keys, self.fps, self.rows = [], [], 0
        self.crowded = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.keys.append(keys)
        self.fps.append(fps)
        self.rows += len(keys)
        if self.rows > HELD_ROWS:
            yield self.leave()

    def leave(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of anchors with more than ``CELL`` rows, now or before."""
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint32)
        fps = np.concatenate(self.fps) if self.fps else np.zeros(0, np.uint64)
        anchor = keys & np.uint32(HOME - 1)
        u, n = np.unique(anchor, return_counts=True)
        self.crowded = np.union1d(self.crowded, u[n > CELL])
        out = np.isin(anchor, self.crowded)
        self.keys, self.fps, self.rows = [keys[~out]], [fps[~out]], int((~out).sum())
        return keys[out], fps[out]

    def edges(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Compare what stayed, anchor by anchor."""
        keys, fps = self.keys[0], self.fps[0]
        anchor = keys & np.uint32(HOME - 1)
        order = np.argsort(anchor, kind="stable")
        anchor, fps, home = anchor[order], fps[order], (keys[order] & np.uint32(HOME)) != 0
        cuts = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
        return [forest(fps[lo:hi][home[lo:hi]], fps[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi - lo > 1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by part: edges (key null), and as they are the rows of crowded anchors (a null)."""
    now, held = None, _Part()

    def crowd(rows: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int64)), none, pa.array(rows[1].view(np.int64))],
                                          names=["key", "a", "b"])

    def finish() -> Iterator[pa.RecordBatch]:
        yield crowd(held.leave())
        a, b = _joined(held.edges())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    for batch in batches:
        for part, keys, fps in zip(*(batch.column(c) for c in ("part", "keys", "fps")), strict=True):
            if part.as_py() != now:
                yield from finish()
                now, held = part.as_py(), _Part()
            for rows in held.add(np.frombuffer(keys.as_buffer(), np.uint32), np.frombuffer(fps.as_buffer(), np.uint64)):
                yield crowd(rows)
    yield from finish()


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, cell), the cells bounding the runs."""
    def edges_of(run: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        fp = np.concatenate([r[0] for r in run])
        return forest(fp[np.concatenate([r[1] for r in run])], np.unique(fp))

    held, held_key = [], None   # the run that may go on in the next batch
    for batch in batches:
        anchor, cell = batch.column("anchor").to_numpy(), batch.column("cell").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(anchor) != 0) | (np.diff(cell) != 0)) + 1).tolist(), len(anchor)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi and (here := (anchor[lo], cell[lo])) != held_key:
                if held:
                    yield _edge_batch(edges_of(held))
                held, held_key = [], here
            held.append((fp[lo:hi], home[lo:hi]))
    if held:
        yield _edge_batch(edges_of(held))


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    none = [np.zeros(0, np.uint64)]
    return [np.concatenate([p[i] for p in parts] or none).view(np.int64) for i in (0, 1)]


def _edge_batch(edges: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _joined([edges])], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within four bits."""
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() // PART_ROWS + 1)
    dealt = distinct.select("fp").mapInArrow(lambda b: _deal(b, parts), "part long, keys binary, fps binary")
    first = written(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        _compare, "key long, a long, b long"), "simhash-anchors")
    crowd = first.where("key IS NOT NULL").selectExpr(f"key & {HOME - 1} AS anchor", f"(key & {HOME}) <> 0 AS home", "b AS fp")
    # crowded anchors: a grid of cells, ``down`` parts of those at home by ``across`` parts of all
    grid = written(crowd.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n"))
                   .where("homes > 0")
                   .selectExpr("anchor", f"ceil(homes / {CELL}) AS down", f"ceil(n / {CELL}) AS across"), "simhash-grid")
    edges = first.where("key IS NULL").select("a", "b")
    if grid.isEmpty():
        return edges
    many = crowd.join(grid, "anchor").selectExpr(
        "*", "pmod(xxhash64(fp, 7), down) AS i", "pmod(xxhash64(fp, 8), across) AS j")
    copied = many.selectExpr("anchor", "explode(transform(sequence(0, down - 1), x -> x * across + j)) AS cell",
                             "false AS home", "fp")
    at_home = many.where("home").selectExpr(
        "anchor", "explode(transform(sequence(0, across - 1), y -> i * across + y)) AS cell", "home", "fp")
    cells = copied.unionByName(at_home).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return edges.unionByName(cells.mapInArrow(_compare_cells, "a long, b long"))


def _rooted(fps: DataFrame) -> DataFrame:
    """(fp, doc_id, root) of each distinct fingerprint: its smallest id and its component's root."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    groups = components(links(distinct.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    return written(distinct.join(groups, "fp", "left").selectExpr("fp", "doc_id", "coalesce(root, fp) AS root"), "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; links at four or fewer differing bits."""
    fps = written(fingerprints(docs, shingle), "simhash-fp")
    rooted = _rooted(fps)
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(rooted.join(first, "root").select("fp", "component_id"), "simhash-groups")
    return (fps.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, null ids last, then the smallest text hash."""
    own, none, text = key = ["__own_id", "__no_id", "__own_text"]     # no columns of the documents

    def keys(doc_id: Column, hashed: Column) -> list[Column]:
        """Columns that join null-safely: a null id is one more id."""
        return [F.coalesce(doc_id, F.lit(0)).alias(own), doc_id.isNull().alias(none), hashed.alias(text)]

    fps = written(fingerprints(docs, shingle, hashed=True), "simhash-fp")
    least = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("least"))
    stays = (least.join(_rooted(fps.select("doc_id", "fp")).select("fp", "root"), "fp").groupBy("root")
             .agg(F.min("least").alias("least")).select(*keys(F.col("least.doc_id"), F.col("least.hash"))))
    # joined and made distinct on one partitioning, so the text is shuffled once
    return (docs.select("*", *keys(F.col("doc_id").cast("long"), text_hash())).join(stays, key, "left_semi")
            .dropDuplicates(key).drop(*key))
