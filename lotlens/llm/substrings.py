"""Operator 9: substring deduplication by compressed FM-indexes, one per shard.

A window is SPAN consecutive words of one document; it repeats if its words start anywhere else too, in the same
document or another. To find all places of a window in one shard, documents are cut into segments by minimisers: each
window goes with the smallest hash of the ANCHOR-word runs in it, and neighbouring windows with the same run form one
segment. Equal windows have equal anchors, so a shard that gets all segments of an anchor sees every place of its
windows, and a window lies in one segment.

1. Anchors are counted over all documents; those that occur once can hold no repeated window. A bitmap of fixed size
   (``bitmap``) of the others keeps most of the rest at home.
2. Each task sends every distinct segment once, with its count, however many copies it has; places of segments are
   narrow rows.
3. A shard gathers segments up to SHARD_WORDS words and builds an FM-index over them (``fmindex``). Segments that occur
   once are streamed through it: backward search gives for each place how many words before it occur elsewhere too, and
   windows of SPAN such words are reported. Segments with copies repeat as a whole. The segments of one anchor that are
   too many for an index are counted by window in a shuffle instead, which has no such bound.
4. Places meet the reports of their segment (hot segments are split over tasks) and go back to their documents.

Words are runs of anything but white space, unchanged, known by 48 bits of a hash. Null texts have no words. Texts of
fewer than SPAN words lose nothing. A repeated row counts as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .bitmap import gathered, holds
from .common import WHITE, batches, grams, rounds, saved, text_rows, texts, words
from .fmindex import FMIndex

SPAN, ANCHOR, SHARD_WORDS, HELD_SEGMENTS = 35, 8, 1 << 20, 20_000
#: Words that are cut into segments at once; a longer text is cut in parts that share SPAN - 1 words.
PART_WORDS = 1 << 20

_ANCHORS = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()),
                       ("segment", pa.int64()), ("anchor", pa.int64()), ("copies", pa.int64()), ("words", pa.binary())])
_SEGMENTS_DDL = ("doc_id long, _h long, first long, windows int, segment long, anchor long, copies long, words binary")
_REPORTS = pa.schema([("segment", pa.int64()), ("runs", pa.binary()), ("words", pa.binary())])
_REPORTS_DDL = "segment long, runs binary, words binary"
_WINDOWS = pa.schema([("segment", pa.int64()), ("at", pa.int32()), ("window", pa.int64())])


def _short(h: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()


def _long(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data[:4 * n], "<u4").astype(np.uint64) | (np.frombuffer(data[4 * n:], "<u2").astype(np.uint64) << np.uint64(32))


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    width, out = 1, key
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(key) - n + 1], out[n - width:]) if n > width else out


def _cut(h: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of some rows' words: row, first word (of all), windows, anchor."""
    empty = np.empty(0, np.int64)
    if len(h) < span:
        return empty, empty, empty, np.empty(0, np.uint64)
    g = grams(h, ANCHOR)
    key = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
    least = _least(key, span - ANCHOR + 1) & np.uint64((1 << 24) - 1)  # of the window from each word on
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    fits = (np.arange(len(least)) + span <= off[row[:len(least)] + 1])
    at = np.flatnonzero(fits)
    if not len(at):
        return empty, empty, empty, np.empty(0, np.uint64)
    least, row = least[at].astype(np.int64), row[at]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(at) != 1) | (row[1:] != row[:-1])]))
    return row[new], at[new], np.diff(np.append(new, len(at))), g[least[new]]


def _segments(buf: np.ndarray, off: np.ndarray, span: int) -> Iterator[tuple]:
    """(row, first word of the row, windows, anchor, word hashes) arrays, by rounds of bounded size."""
    for lo, hi in rounds(off):
        h, _, _, w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], WHITE)
        h &= np.uint64((1 << 48) - 1)
        for part in range(0, max(1, len(h) - span + 1), PART_WORDS):
            # Only a row that is alone in its round can have more than one part.
            some, w_some = (h, w) if len(h) <= PART_WORDS else (h[part:part + PART_WORDS + span - 1], None)
            if w_some is None:
                w_some = np.array([0, len(some)])
            row, first, n, anchor = _cut(some, w_some, span)
            yield lo + row, first, part + first - w_some[row], n, anchor, some


def _anchors(docs: DataFrame, span: int) -> DataFrame:
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for *_, anchor, _ in _segments(*texts(part.column(0)), span):
                seen, n = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], schema=_ANCHORS)

    return (docs.select("text").mapInArrow(work, "anchor long, n long").groupBy("anchor")
            .agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))


def _sent(docs: DataFrame, repeated: np.ndarray, span: int) -> DataFrame:
    """Places (with doc_id, _h, first, windows) and distinct segments (with anchor, copies, words) of repeated anchors."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def drained() -> Iterator[tuple]:
            for segment, (anchor, copies, n, data) in held.items():
                yield None, None, None, n, segment, anchor, copies, data
            held.clear()

        def rows() -> Iterator[tuple]:
            for part in parts:
                ids, keys = part.column("doc_id").to_pylist(), part.column("_h").to_pylist()
                for row, at, first, n, anchor, h in _segments(*texts(part.column("text")), span):
                    keep = np.flatnonzero(holds(repeated, anchor))
                    signed = anchor.view(np.int64)
                    for r, a, f, k, x in zip(row[keep].tolist(), at[keep].tolist(), first[keep].tolist(),
                                             n[keep].tolist(), signed[keep].tolist(), strict=True):
                        body = h[a:a + k + span - 1]
                        segment = xxhash.xxh3_64_intdigest(body.tobytes()) - (1 << 63)
                        yield ids[r], keys[r], f, k, segment, None, None, None
                        known = held.get(segment)
                        if known is None:
                            held[segment] = [x, 1, k, _short(body)]
                        else:
                            known[1] += 1
                    if len(held) > HELD_SEGMENTS:
                        yield from drained()
            yield from drained()

        yield from batches(_SEGMENTS, rows())

    return docs.select("doc_id", "_h", "text").mapInArrow(work, _SEGMENTS_DDL)


def _runs(windows: np.ndarray) -> bytes:
    """First and last of the runs in ascending window numbers."""
    if not len(windows):
        return b""
    new = np.flatnonzero(np.diff(windows) != 1)
    return np.stack([windows[np.append(0, new + 1)], windows[np.append(new, len(windows) - 1)]], 1).astype("<i4").tobytes()


def _indexed(segments: list[tuple[int, int, bytes]], span: int) -> Iterator[tuple]:
    """Reports of (segment, copies, words) through one index over them."""
    bodies = [_long(data) for _, _, data in segments]
    index = FMIndex(bodies, span)
    single = [k for k, s in enumerate(segments) if s[1] == 1]
    counts = [len(bodies[k]) - span + 1 for k in single]
    ends = np.concatenate([index.starts[k] + np.arange(span, len(bodies[k]) + 1) for k in single] or [np.empty(0, np.int64)])
    matched = index.longest(ends, least=2, most=span) >= span
    at = 0
    for k, n in zip(single, counts, strict=True):
        runs = _runs(np.flatnonzero(matched[at:at + n]))
        at += n
        if runs:
            yield segments[k][0], runs, None
    for segment, copies, data in segments:
        if copies > 1:
            yield segment, _runs(np.arange(len(data) // 6 - span + 1)), None


def _reports(sent: DataFrame, span: int, shard_words: int) -> DataFrame:
    """segment and its repeated windows; segments of anchors that no index can hold come back with their words."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            """(anchor, segment, copies, words), copies of one segment added up."""
            last = None
            for part in parts:
                for anchor, segment, copies, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if last and last[0] == anchor and last[1] == segment:
                        last = (anchor, segment, last[2] + copies, data)
                    else:
                        if last:
                            yield last
                        last = (anchor, segment, copies, data)
            if last:
                yield last

        def rows() -> Iterator[tuple]:
            index, size = [], 0      # complete groups for the next index
            group, own, over = [], 0, False
            now = None

            def closed() -> list[tuple]:
                if len(group) > 1 or group and group[0][1] > 1:
                    return list(group)
                return []

            for anchor, segment, copies, data in groups():
                if anchor != now:
                    done = closed() if not over else []
                    index += done
                    size += own if done else 0
                    if size > shard_words:
                        yield from _indexed(index, span)
                        index, size = [], 0
                    now, group, own, over = anchor, [], 0, False
                group.append((segment, copies, data))
                own += len(data) // 6
                if over or own > shard_words:
                    for s, c, d in group:
                        yield s, _runs(np.arange(len(d) // 6 - span + 1)) if c > 1 else None, d
                    group, over = [], True
            if not over:
                index += closed()
            if index:
                yield from _indexed(index, span)

        yield from batches(_REPORTS, rows())

    return (sent.where("words is not null").select("anchor", "segment", "copies", "words")
            .repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(work, _REPORTS_DDL))


def _by_window(reports: DataFrame, span: int) -> DataFrame:
    """Reports of the segments that came back with their words, by counting every window of theirs."""
    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for segment, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                w = grams(_long(data), span).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), segment, np.int64)),
                                                  pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w)], schema=_WINDOWS)

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(_REPORTS, ((s, _runs(np.array(sorted(a))), None) for part in parts
                                      for s, a in zip(*(c.to_pylist() for c in part.columns), strict=True)))

    every = reports.where("words is not null").select("segment", "words").mapInArrow(spread, "segment long, at int, window long")
    # A place of the window in another segment, or twice in this one.
    counts = every.groupBy("window").agg(F.count("*").alias("n"))
    hit = attach(every, counts.where("n > 1"), ["window"], "inner", counts)
    return hit.groupBy("segment").agg(F.collect_set("at").alias("at")).mapInArrow(runs, _REPORTS_DDL)


def covered(docs: DataFrame, span: int = SPAN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that hold repeated windows: doc_id, _h, and their runs as (first, last) window numbers."""
    rows = text_rows(docs)
    sent = saved(_sent(rows, gathered(_anchors(rows, span)), span), "segments")
    reports = saved(_reports(sent, span, shard_words), "reports")
    runs = reports.where("runs is not null").unionByName(_by_window(reports, span)).select("segment", "runs")
    places = sent.where("words is null").select("doc_id", "_h", "first", "segment")
    sizes = places.groupBy("segment").agg(F.count("*").alias("n"))
    met = attach(places, runs.groupBy("segment").agg(F.collect_list("runs").alias("runs")), ["segment"], "inner", sizes)
    return met.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("first", "runs")).alias("found"))


def deduplicated(docs: DataFrame, span: int = SPAN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words, joined by one space) of every document."""
    found = covered(docs, span, shard_words).select(F.col("doc_id").alias("f_doc"), F.col("_h").alias("f_h"), "found")
    rows = text_rows(docs)
    both = (rows.join(found, rows["doc_id"].eqNullSafe(found["f_doc"]) & (rows["_h"] == found["f_h"]), "left")
            .select("doc_id", "text", "found"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for part in parts:
                for doc, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = (text or "").encode().split()
                    if not found:
                        yield doc, len(own), 0, b" ".join(own).decode()
                        continue
                    edge = np.zeros(len(own) + 1, np.int32)
                    for f in found:
                        for runs in f["runs"]:
                            pairs = np.frombuffer(runs, "<i4").reshape(-1, 2) + f["first"]
                            np.add.at(edge, pairs[:, 0], 1)
                            np.add.at(edge, pairs[:, 1] + span, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    yield doc, len(own), int(gone.sum()), b" ".join([w for w, g in zip(own, gone, strict=True) if not g]).decode()

        yield from batches(schema, out(), most=500)

    return both.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
