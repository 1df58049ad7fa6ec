"""Chunks of documents, and finding values that several chunks share.

Documents are packed once into rows of about ``CHUNK`` text bytes (compressed),
written to the shared folder.  To learn which of its values occur elsewhere, a
chunk sends each distinct value once, sorted and cut by value range, and gets
one byte per value back in the same order; so a value that a third of all
documents hold costs one entry per chunk, and replies need no key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

CHUNK = 2 << 20
KEY_BYTES = 6      # leading bytes of a 64-bit hash that the first, filtering exchange sends
LAST_ID = np.iinfo(np.int64).max     # stands for a null id: after all others


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(data.as_buffer()) as r:
        return r.read_all().combine_chunks()


class Chunks:
    """Hands out chunk rows (chunk, data) with ids that are unique over the tasks of one job."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def row(self, table: pa.Table) -> tuple[int, bytes]:
        self.next += 1
        return self.next, to_ipc(table)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, data) rows: Arrow tables of doc_id and raw, the text's bytes (null: empty); written once."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held, size = Chunks(), [], 0

        def flush() -> pa.RecordBatch:
            chunk, data = chunks.row(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([data], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            raw = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            lengths = np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1])
            whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), raw], names=["doc_id", "raw"])
            at, total = 0, size
            for i, n in enumerate(lengths.tolist()):
                total += n + 16
                if total >= CHUNK:
                    held.append(whole.slice(at, i + 1 - at))
                    yield flush()
                    held, at, total = [], i + 1, 0
            if at < len(lengths):
                # a copy, so that the rest does not keep the whole batch
                held.append(pa.RecordBatch.from_arrays([c.take(pa.array(range(at, len(lengths)))) for c in whole.columns],
                                                       names=["doc_id", "raw"]))
            size = total
        if held:
            yield flush()

    return written(src.mapInArrow(run, "chunk long, data binary"), "chunks")


def parts_for(chunks: DataFrame) -> int:
    """Value ranges of an exchange: one for about eight chunks, and at least the shuffle partitions."""
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 8 + 1)


def cut_points(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending 64-bit keys fall into ``parts`` equal ranges (parts + 1 positions)."""
    step = (1 << 64) // parts
    return np.concatenate(([0], np.searchsorted(keys, np.array([step * i for i in range(1, parts)], np.uint64)), [len(keys)]))


def leading(keys: np.ndarray) -> np.ndarray:
    """The leading ``KEY_BYTES`` bytes of each key (keys x bytes)."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def from_leading(data: np.ndarray) -> np.ndarray:
    full = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    full[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    return full.view(">u8").ravel().astype(np.uint64)


def blobs(chunk: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each non-empty value range: (part, chunk, v0, v1, ...)."""
    cuts = cut_points(keys, parts)
    some = np.flatnonzero(np.diff(cuts))
    arrays = [pa.array(some, pa.int64()), pa.array(np.full(len(some), chunk), pa.int64())]
    arrays += [pa.array([c[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays(arrays, names=["part", "chunk", *(f"v{i}" for i in range(len(columns)))])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """Rows sorted by part, gathered: (part, chunks, [bytes of each column] of each row)."""
    now, chunks, rows = None, [], []
    for batch in batches:
        columns = [batch.column(i) for i in range(2, batch.num_columns)]
        for i, (part, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if part != now and rows:
                yield now, chunks, rows
                chunks, rows = [], []
            now = part
            chunks.append(chunk)
            rows.append([np.frombuffer(c[i].as_buffer(), np.uint8) for c in columns])
    if rows:
        yield now, chunks, rows


def exchange(chunks: DataFrame, send: Callable, answer: Callable, columns: int, parts: int) -> DataFrame:
    """(chunk, part, reply): one byte for each value a chunk sent, in the order sent.

    ``send(chunk, data)`` yields ``blobs``; ``answer(rows)`` gets the byte
    columns of all chunks' values of one range and returns a byte array for each.
    """
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                yield from send(chunk, data)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, rows in by_part(batches):
            replies = [r.astype(np.uint8).tobytes() for r in answer(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([part] * len(ids)), pa.array(replies, pa.binary())],
                                             names=["chunk", "part", "reply"])

    kinds = "".join(f", v{i} binary" for i in range(columns))
    sent = chunks.select("chunk", "data").mapInArrow(out, f"part long, chunk long{kinds}")
    return (sent.repartition(parts, "part").sortWithinPartitions("part", "chunk")
            .mapInArrow(back, "chunk long, part long, reply binary"))


def with_replies(chunks: DataFrame, replies: DataFrame, label: str) -> DataFrame:
    """(chunk, data, reply) rows: the chunk's replies, joined in the order its values were sent."""
    gathered = replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("r"))
    gathered = written(gathered.selectExpr(
        "chunk", "aggregate(r, CAST('' AS BINARY), (a, x) -> concat(a, x.reply)) AS reply"), label)
    return chunks.select("chunk", "data").join(gathered, "chunk", "left")


def reply_bytes(reply: pa.Scalar) -> np.ndarray:
    return np.frombuffer(reply.as_buffer(), np.uint8) if reply.is_valid else np.zeros(0, np.uint8)


def group_ids(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct row of the columns (first one sorts first), and how many there are."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids, int(ids.max(initial=-1)) + 1


def split_like(values: np.ndarray, rows: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """``values`` cut back into the rows' lengths, ``width`` bytes of the first column each."""
    return np.split(values, np.cumsum([len(r[0]) // width for r in rows])[:-1])
