"""A set of 64-bit hashes as a bitmap of fixed size that may say yes by mistake, never no.

It only spares work: rows that pass it are joined or counted exactly later.
Its size is fixed by ``bits``, whatever is put in, so it may be broadcast; on a
set far larger than that it passes most rows and the exact step does more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

BITS = 27
_PAGE = 1 << 16
_PAGES = pa.schema([("page", pa.int32()), ("bits", pa.binary())])


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(64 - bits)) & mask).astype(np.int64)


def gathered(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of a one-column table of longs: 2^bits bits, made on the executors page by page."""
    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for part in parts:
            h = np.asarray(part.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            for at in _places(h, bits):
                for bit in range(8):
                    out[at[(at & 7) == bit] >> 3] |= 1 << bit
        size = min(_PAGE, len(out))
        pages = out.reshape(-1, size)
        yield from batches(_PAGES, ((int(p), pages[p].tobytes()) for p in np.flatnonzero(pages.any(1))), most=16)

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, page = None, None
            for part in parts:
                for p, some in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if p != now:
                        if now is not None:
                            yield now, page.tobytes()
                        now, page = p, np.frombuffer(some, np.uint8).copy()
                    else:
                        page |= np.frombuffer(some, np.uint8)
            if now is not None:
                yield now, page.tobytes()

        yield from batches(_PAGES, out(), most=16)

    ddl = "page int, bits binary"
    pages = hashes.mapInArrow(mark, ddl).repartition("page").sortWithinPartitions("page").mapInArrow(join, ddl)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for p, some in pages.collect():  # 2^bits bits at most
        out[p * len(some):(p + 1) * len(some)] = np.frombuffer(some, np.uint8)
    return out


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of an array of hashes may be in the set."""
    bits = int(len(bitmap)).bit_length() + 2
    a, b = _places(h, bits)
    found = (bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & 1
    return (found & (bitmap[b >> 3] >> (b & 7).astype(np.uint8))).astype(bool)
