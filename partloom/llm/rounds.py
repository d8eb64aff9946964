"""Exchange of compact keys between batches of documents and key buckets.

Several operators must ask the whole corpus about every n-gram of every document.  One row per n-gram would move many
times the input, so documents are dealt into batches by a hash of their id; a batch sends each bucket one row with the
sorted, distinct keys it holds (a combine before the shuffle: the most frequent key in the corpus costs one entry per
batch), the bucket answers each batch with one row, and the answers meet the documents again in a co-grouping by batch.
All rounds of a query share one exchange of the documents, and no key, however frequent, gathers its rows in a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes


def batch_number(docs: DataFrame, text: str = "text", unit: int = 32 << 10, most: int = 32 << 20) -> int:
    """Batches grow with the square root of the input, so that the messages between n batches and n buckets stay a
    fixed share of it, up to ``most`` bytes of text in a batch, which bounds a task's memory.  Beyond ``most``^2 / ``unit`` (34 GB
    of text) messages carry fewer keys each."""
    size = text_bytes(docs, text)
    return max(4, math.ceil(math.sqrt(size / unit)), math.ceil(size / most))


def deal(docs: DataFrame, batches: int, key: str, text: str) -> DataFrame:
    """``(batch, rows)``: the documents dealt into batches by a hash of ``key``, as compressed Arrow streams of at most
    a few megabytes (a longer row is a stream by itself).  Text moves at about a third of its size, and few rows do.
    Rows whose key is null are spread by their place in the input."""
    schema = docs.schema.names
    spot = F.coalesce(F.xxhash64(F.col(key)) + F.when(F.col(key).isNull(), F.lit(None)).otherwise(F.lit(0)), F.xxhash64(F.monotonically_increasing_id()))
    numbered = docs.withColumn("_batch", F.pmod(spot, F.lit(batches)).cast("int"))

    def pack(source):
        for batch in slices(source, text, 16 << 20):
            number = batch.column(len(schema)).to_numpy()
            order = np.argsort(number, kind="stable")
            rows = batch.select(schema).take(pa.array(order))
            lead = np.flatnonzero(np.concatenate(([True], number[order][1:] != number[order][:-1]))) if len(order) else []
            bounds = [*map(int, lead), len(order)]
            for part in range(0, len(lead), 16):
                spans = list(zip(bounds[part:-1], bounds[part + 1 :]))[:16]
                blobs = []
                for a, b in spans:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(rows.slice(a, b - a))
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(number[order][[a for a, _ in spans]], pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "rows"])

    return numbered.mapInArrow(pack, "batch int, rows binary")


def unpacked(table: pa.Table, text: str, limit: int = 2 << 20):
    """The documents of a batch as record batches of about ``limit`` bytes of text, one stream at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for blob in table.column("rows"):
        for batch in pa.ipc.open_stream(blob.as_buffer()):
            for part in slices([batch], text, limit):
                held.append(part)
                size += part.nbytes
                if size >= limit:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted 64-bit keys: the buckets that have any, and the bounds of their slices.  A bucket is a key range."""
    width = np.uint64((1 << 64) // buckets + 1)
    edges = np.arange(1, buckets, dtype=np.uint64) * width
    bounds = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    return full, bounds


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array with the first bytes of all entries together, then the second ones, and so on: high bytes of
    sorted keys and of small counts then compress to almost nothing in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


KEY_BYTES = 5


def short_planes(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
    """``planes`` of 40 bits of each key inside its bucket's range; with the bucket's number they name a key on 40 bits
    and one more for each doubling of the buckets."""
    width = (1 << 64) // buckets + 1
    inside = keys - np.uint64((bucket * width) & ((1 << 64) - 1))
    cut = (inside >> np.uint64(max(0, width.bit_length() - 8 * KEY_BYTES))).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(cut[:, :KEY_BYTES].T).tobytes()


def from_short_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(KEY_BYTES, -1).T
    return out.view(np.uint64).ravel()


def counts_to_bytes(values: np.ndarray) -> bytes:
    """Counts in the smallest unsigned type that holds them; its size comes first."""
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) >> 8 * n == 0)
    return bytes([size]) + planes(values.astype(f"<u{size}"))


def counts_from_bytes(data: bytes) -> np.ndarray:
    return from_planes(data[1:], f"<u{data[0]}").astype(np.int64)


def message(bucket: list, batch: int, **blobs: list[bytes]) -> pa.Table:
    n = len(bucket)
    columns = {"bucket": pa.array(bucket, pa.int32()), "batch": pa.array([batch] * n, pa.int32())}
    return pa.table(columns | {k: pa.array(v, pa.binary()) for k, v in blobs.items()})


def joined(table: pa.Table, column: str, kind=np.uint64) -> np.ndarray:
    """All blobs of a column as one array."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def senders(table: pa.Table, column: str, item: int) -> np.ndarray:
    """The row number of every entry of ``joined``."""
    sizes = [len(x) // item for x in table.column(column).to_pylist()]
    return np.repeat(np.arange(len(sizes)), sizes)
