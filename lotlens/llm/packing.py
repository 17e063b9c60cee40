"""Operator 4: documents packed into sequences of a fixed window by best-fit decreasing.

A document's ids (with the end id) are first cut into full windows; what is
left of it goes, longest first, into the open window whose remaining capacity
fits it tightest, found in a segment tree over capacities. Each task packs the
documents it reads in groups of bounded size and carries its open windows from
group to group, so no row leaves its task and memory doesn't grow with the
input. Windows that lack ``slack`` ids or less are closed after a group. When a
task carries too many open windows, or ends, it cuts their pieces anew so that
they fill whole windows; the last rest of a task becomes sequences whose
lengths are powers of two, which need no padding.

Null and empty texts have the end id alone. Repeated rows are packed one by
one. A document with a null id is packed like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

WINDOW, END_ID, SLACK = 1024, 0, 4
GROUP_IDS, MOST_OPEN = 1 << 21, 1024
#: Runs of text that a worker remembers where packing has the worker to itself.
REMEMBERED = 800_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Capacities:
    """A segment tree over remaining capacities 0..most, with a stack of open windows at each leaf."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list] = defaultdict(list)

    def _add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, capacity: int, item) -> None:
        self.open[capacity].append(item)
        self._add(capacity, 1)

    def tightest(self, need: int):
        """Takes out a window of the least capacity that is at least ``need``; None if there is none."""
        k, count = need + self.size, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until a right neighbour holds some
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        self._add(k - self.size, -1)
        return k - self.size, self.open[k - self.size].pop()

    def drain(self) -> list:
        """All (capacity, window), the fullest first."""
        out = [(c, w) for c in sorted(self.open) for w in self.open[c]]
        self.__init__(self.size - 1)
        return out


class Packer:
    """Packs one task's pieces. A piece is (doc_id, start, doc_tokens, ids as bytes of four to an id)."""

    def __init__(self, first: int, window: int, slack: int, most_open: int):
        self.next, self.window, self.slack, self.most_open = first, window, slack, most_open
        self.free = Capacities(window)

    def sequence(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            yield doc, start, n, total, self.next, at, ids
            at += n
        self.next += 1

    def group(self, pieces: list) -> Iterator[tuple]:
        free, window = self.free, self.window
        for piece in sorted(pieces, key=lambda p: -len(p[3])):
            n = len(piece[3]) // 4
            found = free.tightest(n)
            capacity, held = found or (window, [])
            held.append(piece)
            free.put(capacity - n, held)
        still = []
        for capacity, held in free.drain():
            if capacity <= self.slack:
                yield from self.sequence(held)
            else:
                still.append((capacity, held))
        if len(still) > self.most_open:
            yield from self.close([w for _, w in still], last=False)
        else:
            for capacity, held in still:
                free.put(capacity, held)

    def close(self, windows: list[list], last: bool) -> Iterator[tuple]:
        """Open windows, cut anew into full ones; the rest stays open, or with ``last`` goes out in powers of two."""
        held, room, want = [], 0, self.window
        left = sum(len(p[3]) // 4 for w in windows for p in w)
        for doc, start, total, ids in (p for w in windows for p in w):
            while ids:
                if not room:
                    if left < want and last:
                        want = 1 << (left.bit_length() - 1)
                    room = want
                part, ids = ids[:4 * room], ids[4 * room:]
                n = len(part) // 4
                held.append((doc, start, total, part))
                start, room, left = start + n, room - n, left - n
                if not room:
                    yield from self.sequence(held)
                    held = []
        if held:
            self.free.put(room, held)

    def end(self) -> Iterator[tuple]:
        yield from self.close([w for _, w in self.free.drain()], last=True)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         slack: int = SLACK, group_ids: int = GROUP_IDS, most_open: int = MOST_OPEN, remembered: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens`` (all its ids, with the end
    id), ``sequence_id``, ``offset`` (ids of the sequence before the piece, without gaps) and ``ids`` (little-endian
    unsigned 32-bit integers). ``tokenizer`` is a file that every executor has; None: the installed vocabulary.
    ``remembered`` bounds the runs of text a worker keeps (see ``tokens``); the rows don't depend on it.
    """
    if window < 1 or slack >= window:
        raise ValueError("a window holds at least one id and more than the slack")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer, remembered), int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, window, slack, most_open)
        size = 4 * window

        def rows() -> Iterator[tuple]:
            pieces, n = [], 0
            for part in parts:
                ids, column = part.column("doc_id"), part.column("text")
                _, off = common.texts(column)
                for lo, hi in common.rounds(off, 1 << 18):
                    for doc, body in zip(ids[lo:hi].to_pylist(), encoder.encode(column[lo:hi].to_pylist()), strict=True):
                        body += end
                        total, full = len(body) // 4, len(body) // size * size
                        for at in range(0, full, size):
                            yield from packer.sequence([(doc, at // 4, total, body[at:at + size])])
                        if full < len(body):
                            pieces.append((doc, full // 4, total, body[full:]))
                            n += total - full // 4
                        if n >= group_ids:
                            yield from packer.group(pieces)
                            pieces, n = [], 0
            yield from packer.group(pieces)
            yield from packer.end()

        yield from common.batches(SCHEMA, rows())

    return common.text_rows(docs).select("doc_id", "text").mapInArrow(
        work, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "offset")
