"""Operator 6: benchmark decontamination by spaced-seed hashing.

A seed is a run of words of which a fixed mask leaves some out, so substituted words cannot hide a passage from all
masks. Seeds of the benchmark are joined with seeds of the documents; around each hit the words of the item are held
against those of the document along the hit's diagonal. A stretch is an overlap if at least MIN_WORDS of its words agree
(four fifths of the item, if that is shorter) and at least MIN_SHARE of it does; the one with most such words counts.
With the masks given, no stretch of that share lacks a seed: either five words in a row agree, or neighbouring runs of
agreeing words fit one of the other masks.

Documents meet the benchmark's seeds in a bitmap of fixed size first (``bitmap``), so that only seeds that may be hits
are shuffled; hit places near each other form a region that carries its words along. Items with the same words are one
class. The benchmark's side is copied to SALTS parts, over which the documents of a popular seed are spread.

Words are letters, digits and non-ASCII characters in lower case. Null and empty texts, items of fewer than
LEAST_ITEM words, and rows without id on the benchmark's side take no part. Repeated rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import gathered, holds
from .common import PLAIN, batches, mix, powers, rounds, saved, slices, text_rows, texts, words

#: 1: the word counts; 0: any word may stand there.
MASKS = ("11111", "110111", "111011", "1101011", "1100111")
MIN_WORDS, MIN_SHARE, SALTS, BITS = 13, 0.8, 16, 25
LEAST_ITEM = 8
_REACH = 16  # words that a region keeps on either side of what the longest item could cover

_ITEMS = pa.schema([("item_id", pa.int64()), ("item", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])
_SEEDS = pa.schema([("item", pa.int64()), ("seed", pa.int64()), ("at", pa.int32())])
_REGIONS = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("first", pa.int64()), ("words", pa.binary()),
                      ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_FOUND = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("item", pa.int64()), ("doc_start", pa.int64()),
                    ("item_start", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64())])


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place of an array of word hashes."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, p = np.full(n, np.uint64(int(mask, 2))), powers(len(mask))
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k:k + n] * p[k]
    return mix(out)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (of the same words: the same), n and words of each item that is long enough."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                ids = part.column(0).to_pylist()
                buf, off = texts(pc.utf8_lower(part.column(1)))
                for lo, hi in rounds(off):
                    h, _, _, w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], PLAIN)
                    for k, (a, b) in enumerate(zip(w[:-1].tolist(), w[1:].tolist(), strict=True)):
                        if b - a >= LEAST_ITEM:
                            data = h[a:b].astype("<u8").tobytes()
                            yield ids[lo + k], xxhash.xxh3_64_intdigest(data) - (1 << 63), b - a, data

        yield from batches(_ITEMS, rows())

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "item_id long, item long, n int, words binary")


def _item_seeds(classes: DataFrame) -> DataFrame:
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for item, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    h = np.frombuffer(data, "<u8")
                    for mask in MASKS:
                        for at, s in enumerate(seeds(h, mask).view(np.int64).tolist()):
                            yield item, s, at

        yield from batches(_SEEDS, rows())

    return classes.select("item", "words").mapInArrow(work, "item long, seed long, at int")


def _regions(docs: DataFrame, known: np.ndarray, longest: int) -> DataFrame:
    """Where documents may meet the benchmark: the words there, and the seeds with their places in them."""
    reach = longest + _REACH

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in slices(parts):
                ids, keys = part.column("doc_id").to_pylist(), part.column("_h").to_pylist()
                buf, off = texts(pc.utf8_lower(part.column("text")))
                for lo, hi in rounds(off):
                    h, _, _, w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], PLAIN)
                    row = np.repeat(np.arange(hi - lo), np.diff(w))
                    found = []
                    for mask in MASKS:
                        s = seeds(h, mask)
                        at = np.flatnonzero(holds(known, s))
                        at = at[row[at] == row[at + len(mask) - 1]]  # within one row
                        found.append((at, s[at]))
                    at, s = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(at, kind="stable")
                    at, s = at[order], s[order].view(np.int64)
                    if not len(at):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > reach) | (np.diff(row[at]) > 0)]))
                    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
                        r = int(row[at[a]])
                        lo_w, hi_w = max(int(w[r]), int(at[a]) - reach), min(int(w[r + 1]), int(at[b - 1]) + reach)
                        yield (ids[lo + r], keys[lo + r], lo_w - int(w[r]), h[lo_w:hi_w].astype("<u8").tobytes(),
                               s[a:b].tolist(), (at[a:b] - lo_w).tolist())

        yield from batches(_REGIONS, rows(), most=1000)

    return text_rows(docs).select("doc_id", "_h", "text").mapInArrow(
        work, "doc_id long, _h long, first long, words binary, seeds array<long>, places array<int>")


def _best(agree: np.ndarray, share: float) -> tuple[int, int, int]:
    """First, end and agreeing words of the stretch with most agreeing words of those that agree in ``share`` of theirs."""
    pays = np.concatenate([[0.0], np.cumsum(np.where(agree, 1 - share, -share))])
    least = np.minimum.accumulate(pays)
    first = np.searchsorted(-least, -(pays + 1e-9), "left")  # the longest stretch to each end that agrees enough
    total = np.concatenate([[0], np.cumsum(agree)])
    end = int(np.argmax(total - total[first]))
    start = int(first[end])
    inside = np.flatnonzero(agree[start:end])
    if not len(inside):
        return start, start, 0
    return start + int(inside[0]), start + int(inside[-1]) + 1, len(inside)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
             bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """One row for each document and item class that overlap, and the items by class.

    doc_id, _h, item, doc_start (word of the document), item_start, n_words (of the stretch), n_matched.
    """
    every = saved(items(benchmark), "items")
    classes = every.groupBy("item").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    longest = classes.agg(F.max("n")).first()[0] or 0
    asked = saved(_item_seeds(classes), "seeds")
    regions = saved(_regions(docs, gathered(asked.select("seed"), bits), longest), "regions")
    part = F.pmod(F.xxhash64("doc_id", "_h", "first"), F.lit(SALTS)).cast("int").alias("part")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
    hits = (regions.select("doc_id", "_h", "first", part, F.explode(F.arrays_zip("seeds", "places")).alias("x"))
            .select("doc_id", "_h", "first", "part", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place")))
    lines = (hits.join(asked.select("*", parts), ["seed", "part"])
             .select("doc_id", "_h", "first", "part", "item", (F.col("place") - F.col("at")).alias("line")).distinct())
    lines = lines.join(classes.select("*", parts), ["item", "part"]).drop("part")
    r = regions.select(F.col("doc_id").alias("r_doc"), F.col("_h").alias("r_h"), F.col("first").alias("r_first"),
                       F.col("words").alias("region")).distinct()
    both = lines.join(r, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("_h") == F.col("r_h")) & (F.col("first") == F.col("r_first")))

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in rows:
                for doc, h, first, item, line, data, region in zip(*(batch.column(c).to_pylist() for c in (
                        "doc_id", "_h", "first", "item", "line", "words", "region")), strict=True):
                    a, b = np.frombuffer(data, "<u8"), np.frombuffer(region, "<u8")
                    lo, hi = max(0, -line), min(len(a), len(b) - line)
                    start, end, n = _best(a[lo:hi] == b[lo + line:hi + line], min_share)
                    if n >= min(min_words, -(-len(a) * 4 // 5)) and n >= min_share * (end - start) - 1e-9:
                        yield doc, h, item, first + lo + line + start, lo + start, end - start, n

        yield from batches(_FOUND, out())

    found = both.mapInArrow(work, "doc_id long, _h long, item long, doc_start long, item_start long, n_words long, n_matched long")
    best = F.max(F.struct("n_matched", (-F.col("doc_start")).alias("s"), (-F.col("item_start")).alias("i"), "n_words")).alias("x")
    return (found.groupBy("doc_id", "_h", "item").agg(best)
            .select("doc_id", "_h", "item", (-F.col("x.s")).alias("doc_start"), (-F.col("x.i")).alias("item_start"),
                    "x.n_words", "x.n_matched")), every


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row for each row of documents and benchmark item that overlap, with the stretch where most words agree."""
    found, every = overlaps(docs, benchmark, **how)
    found = saved(found, "overlaps")
    rows = text_rows(docs).select(F.col("doc_id").alias("d_doc"), F.col("_h").alias("d_h"))
    each = found.join(rows, F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.col("_h") == F.col("d_h")))
    return (each.join(every.select("item_id", "item"), "item")
            .select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched"))
