"""Packed exchanges: many small values per row.

Documents are packed into shards, compressed Arrow batches written to the shared
folder. Operators that hold every n-gram or position of a corpus against all
others send one row per shard and hash bucket, a sorted array in a blob, in
place of one row per value; a repeat within a shard is sent once, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.shared import pinned
from panelkit.llm.textscan import text_buffer

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Bytes of packed values that one bucket gathers, about.
BUCKET_BYTES = 24 << 20


#: Level of compression of what travels.
LEVEL = 3


def deflate(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def inflate(blob: bytes, count: int, kind) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), kind) if count else np.zeros(0, kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed byte planes of their differences: the high planes are nearly all zero."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(">u8")
    return deflate(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(blob: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint64)
    planes = inflate(blob, count * 8, np.uint8).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def make(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pinned shards: ``shard``, ``n_bytes`` and ``blob``, an Arrow stream of ``key`` and ``text`` in which a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            joined = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, joined.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
                writer.write_table(joined)
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "n_bytes", "blob"])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            low = 0
            while low < batch.num_rows:
                high = int(np.searchsorted(offsets, offsets[low] + SHARD_BYTES - size, "right")) - 1
                high = min(batch.num_rows, max(low + (not held), high))
                if high > low:
                    part = batch.slice(low, high - low)
                    held.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.large_string()).fill_null("")], ["key", "text"]))
                    size += int(offsets[high] - offsets[low])
                if high < batch.num_rows or size >= SHARD_BYTES:
                    yield close()
                low = high
        if held:
            yield close()

    return pinned(docs.select(key, text).mapInArrow(run, "shard bigint, n_bytes bigint, blob binary"))


def open_shard(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, text bytes and byte offsets of a shard."""
    found = pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks()
    data, offsets = text_buffer(found.column("text").chunk(0) if found.num_rows else pa.array([], pa.large_string()))
    return found.column("key").combine_chunks(), data, offsets


def each_shard(shards: DataFrame, work: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``work(shard, blob, *rest)`` makes of each row; shards are opened one at a time."""
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for rows in work(*(c[k].as_py() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in kinds], schema=kinds)

    return shards.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = T.StructType.fromDDL(schema)
    return pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(parsed)])


def buckets_for(total_bytes: int) -> int:
    """A power of two of buckets that each gather ``BUCKET_BYTES`` or less of packed values."""
    return 1 << max(3, int(np.ceil(np.log2(max(1, total_bytes / BUCKET_BYTES)))))


def split_sorted(values: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets, by their top bits, in sorted 64-bit values."""
    step = (1 << 64) // buckets
    return np.concatenate([[0], np.searchsorted(values, np.array([k * step for k in range(1, buckets)], np.uint64)), [len(values)]]).astype(np.int64)


def each_bucket(requests: DataFrame, work: Callable[[int, pa.Table], Iterator[dict]], schema: str, by: str = "bucket") -> DataFrame:
    """Rows that ``work(bucket, rows)`` makes of all rows of a bucket, whose size ``buckets_for`` bounds."""
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for rows in work(current, pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in kinds], schema=kinds)

        for batch in batches:
            keys = batch.column(by).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if held and keys[low] != current:
                    yield from done()
                    held = []
                current = int(keys[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from done()

    return requests.repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)
