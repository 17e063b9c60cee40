"""What the operators share: scratch tables, row keys, and words as arrays of 64-bit hashes.

Rows are known by what they hold, never by their place in a scan: ``row_key``
is the document id with a hash of the text, so a task that runs again, or a
table that is split another way on the second read, gives the same keys. Rows
that agree in both are interchangeable for every operator here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of text that one round of array work takes; its scratch arrays are some forty times as large.
ROUND_BYTES = 1 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the cluster's shared folder and read back, so that no later job repeats its work."""
    path = f"{shared_dir(df.sparkSession, 'llm')}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the row key ``_h`` of documents with any further columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), text).alias("_h"))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return (buf[off[0]:off[-1]], off - off[0]) if len(column) else (buf[:0], np.zeros(1, np.int64))


def slices(parts: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that copies of a column stay small."""
    for part in parts:
        for lo in range(0, part.num_rows, rows):
            yield part.slice(lo, rows)


def rounds(off: np.ndarray, most: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row comes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.cumprod(np.full(64, _STEP, np.uint64))]


def powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(2 * len(_POWERS[0]), _STEP, np.uint64))
    return _POWERS[0]


#: Byte classes. White space alone parts words; or everything but letters, digits and non-ASCII characters.
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PLAIN = ~(np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
          | (np.arange(256) > 127))


def _bounds(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~gap[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some rows: 64-bit hash, first byte and end byte of each, and the offsets of the rows in these.

    Two words have one hash if they are the same bytes; different words share one with probability 2^-64 a pair.
    """
    if len(buf) > 4 * ROUND_BYTES:  # one very long row: by parts that end between words
        parts, at, stop = [], 0, gap[buf]
        while at < len(buf):
            to = min(len(buf), at + ROUND_BYTES)
            if to < len(buf):
                back = np.flatnonzero(stop[at:to])
                more = None if len(back) else np.flatnonzero(stop[to:])
                to = at + back[-1] + 1 if len(back) else to + more[0] + 1 if len(more) else len(buf)
            h, a, b, _ = _words(buf[at:to], gap)
            parts.append((h, a + at, b + at))
            at = to
        h, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        cut = buf
        if len(off) > 2:  # words don't run on from one row into the next
            cut = np.empty(len(buf) + len(off) - 2, np.uint8)
            keep = np.ones(len(cut), bool)
            keep[off[1:-1] + np.arange(len(off) - 2)] = False
            cut[keep] = buf
            cut[~keep] = 32
        h, a, b, _ = _words(cut, gap)
        if len(off) > 2:
            shift = np.searchsorted(off[1:-1] + np.arange(len(off) - 2), a, "left")
            a, b = a - shift, b - shift
            return h, a, b, np.concatenate([[0], np.searchsorted(shift, np.arange(len(off) - 2), "right"), [len(a)]])
    if len(off) == 2:
        return h, a, b, np.array([0, len(h)])
    return h, a, b, np.concatenate([np.searchsorted(a, off[:-1], "left"), [len(a)]])


def _words(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = _bounds(buf, gap)
    if not len(a):
        return np.empty(0, np.uint64), a, b, a
    n = b - a
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(n.sum()) - np.repeat(first, n)
    body = buf[place + np.repeat(a, n)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(body * powers(int(n.max()))[place], first) + n.astype(np.uint64)), a, b, first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` neighbours of an array of hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    p = powers(n)
    for k in range(n):
        out += h[k:k + len(out)] * p[n - 1 - k]
    return mix(out)


def batches(schema: pa.Schema, rows: Iterator[Sequence], most: int = 5_000, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from rows."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)],
                                          schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if len(held) >= most or size >= most_bytes:
            yield out()
            held, size = [], 0
    if held:
        yield out()
