"""Operator 5: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams of LENGTHS characters that occur in its lower-case text, hashed to BUCKETS. Over
all labelled training rows Spark counts in how many toxic and how many clean documents each bucket occurs; the log of
the ratio of the two smoothed shares scales the feature. Buckets with enough evidence are kept, FEATURES at most, and
a logistic regression over the scaled features is fitted on a bounded sample: at most ``most_rows`` training rows, by
hash, not by place. Counts cover all rows; only the sample's kept features (MOST_ROWS * FEATURES numbers at most, in
practice a few hundred a row) and the counts (BUCKETS numbers) pass through the driver.

Labels, languages, sources and ids are no inputs of a score. Null and empty texts have no n-gram and score as the
intercept does. Rows of ``labels`` with a null take no part; a document with several labels is toxic if one says so.
Without labelled rows of both classes every document scores the smoothed share of toxic ones. Repeated rows are scored
one by one; those with one id share its labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, saved

LENGTHS, BUCKETS, FEATURES, MOST_ROWS, THRESHOLD = (3, 4, 5), 1 << 20, 8192, 8192, 0.3
#: Standard errors between a bucket's two shares that make it a feature; the surest LEAST_FEATURES always are.
EVIDENCE, LEAST_FEATURES = 5.0, 100
_BITS, _RANGE = 20, 1 << 14
#: Features that the fit takes at a time, so that its scratch arrays stay small on the driver.
FIT_BLOCK = 1 << 17
_COUNTS = pa.schema([("range", pa.int32()), ("rows", pa.binary())])
_SAMPLE = pa.schema([("row", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary())])
_STEP, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket at each place of the joined texts for each length, -1 where an n-gram would run over; ends of the texts."""
    joined = "".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(joined, "<u4").astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(chars))
    out, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        m = len(chars) - n + 1
        if m > 0:
            h[:m] = h[:m] * _STEP + chars[n - 1:]
        if n in LENGTHS:
            b = (((h + np.uint64(n)) * _ODD) >> np.uint64(64 - _BITS)).astype(np.int64)
            b[left < n] = -1
            out.append(b)
    return out, ends


def _sets(texts: list[str], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, or with ``keep`` (number of a bucket or -1) the numbers of those kept."""
    flags = np.zeros(BUCKETS, bool)
    at = 0
    found, ends = _buckets(texts)
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        at = [b[lo:hi] for b in found]
        if keep is not None:
            ids = np.concatenate([keep[b[b >= 0]] for b in at])
            yield np.unique(ids[ids >= 0])
        elif hi - lo < 4000:
            ids = np.concatenate(at)
            yield np.unique(ids[ids >= 0])
        else:
            for b in at:
                flags[b[b >= 0]] = True
            ids = np.flatnonzero(flags)
            flags[ids] = False
            yield ids


def _rounds(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    held, size, start = [], 0, 0
    for k, t in enumerate(texts):
        held.append((t or "").lower())
        size += len(held[-1]) + 64
        if size >= most:
            yield start, held
            held, size, start = [], 0, k + 1
    if held:
        yield start, held


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0 or 1) and a hash of each labelled row that isn't held out."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(~held_out(F.col("doc_id")))
    # Labels cover a share of the documents, so both are shuffled at any size: one plan, whose cost follows the input.
    return (rows.join(known.hint("merge"), "doc_id")
            .select("text", F.col("_toxic").alias("toxic"), F.xxhash64(F.lit(5), "doc_id", "text").alias("row")))


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many clean and toxic rows each bucket occurs, and the rows of each class."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for part in parts:
            toxic = part.column("toxic").to_pylist()
            for start, texts in _rounds(part.column("text").to_pylist()):
                for k, ids in enumerate(_sets(texts)):
                    counts[toxic[start + k], ids] += 1
                    sizes[toxic[start + k]] += 1
        out = [(-1, sizes.astype("<i8").tobytes())] if sizes.any() else []
        for r in range(BUCKETS // _RANGE):
            some = counts[:, r * _RANGE:(r + 1) * _RANGE]
            if some.any():
                out.append((r, some.astype("<i8").tobytes()))
        yield from batches(_COUNTS, iter(out), most=8)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:  # packed, as these rows go to the driver
            now, total = None, None
            for part in parts:
                for r, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = np.frombuffer(counts, "<i8")
                    if r != now:
                        if now is not None:
                            yield now, pa.compress(total.tobytes(), codec="zstd", asbytes=True)
                        now, total = r, counts.copy()
                    else:
                        total += counts
            if now is not None:
                yield now, pa.compress(total.tobytes(), codec="zstd", asbytes=True)

        yield from batches(_COUNTS, out(), most=8)

    ddl = "range int, rows binary"
    total = (rows.select("text", "toxic").mapInArrow(count, ddl)
             .repartition("range").sortWithinPartitions("range").mapInArrow(add, ddl).collect())
    counts, sizes = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r, some in total:
        some = np.frombuffer(pa.decompress(some, 16 if r < 0 else 16 * _RANGE, codec="zstd", asbytes=True), "<i8")
        if r < 0:
            sizes = some
        else:
            counts[:, r * _RANGE:(r + 1) * _RANGE] = some.reshape(2, -1)
    return counts, sizes


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def keep(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def _fit(sets: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; all sums run in a fixed order."""
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    blocks, lo = [], 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FIT_BLOCK, "right")))
        blocks.append((lo, hi, np.concatenate(sets[lo:hi]).astype(np.int32), np.repeat(np.arange(hi - lo, dtype=np.int32), size[lo:hi])))
        lo = hi

    def by_row(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, x[column], hi - lo) for lo, hi, column, row in blocks] or [np.empty(0)])

    top = 0.25 * max(1.0, float(by_row(scale ** 2).mean() if size.sum() else 0) + 1) + ridge
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    w, b = np.zeros(len(scale)), float(np.log(share / (1 - share)))
    v, c, rate = w.copy(), b, 1 / top

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        z = by_row(scale * w) + b
        return float((np.logaddexp(0, z) - toxic * z).mean() + 0.5 * ridge * (w @ w)), z

    def by_feature(gap: np.ndarray) -> np.ndarray:
        out = np.zeros(len(scale))
        for lo, hi, column, row in blocks:
            out += np.bincount(column, gap[lo:hi][row], len(scale))
        return out * scale

    for t in range(steps):
        at, z = loss(v, c)
        gap = (1 / (1 + np.exp(-z)) - toxic) / len(toxic)
        gw, gb = by_feature(gap) + ridge * v, float(gap.sum())
        slope = float(gw @ gw + gb * gb)
        if slope < 1e-14:
            break
        rate *= 2
        while loss(v - rate * gw, c - rate * gb)[0] > at - 0.5 * rate * slope and rate > 1e-9:
            rate /= 2
        w2, b2 = v - rate * gw, c - rate * gb
        pull = t / (t + 3)
        v, c = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    return w, b


def _chosen(counts: np.ndarray, sizes: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with enough evidence, in order, and the logs of their ratios; range by range, for the driver's sake."""
    # Evidence: how surely the two shares differ.
    sure = np.zeros(BUCKETS)
    for lo in range(0, BUCKETS, _RANGE):
        some = counts[:, lo:lo + _RANGE]
        clean, toxic = (some + smooth) / (sizes + 2 * smooth)[:, None]
        pooled = (some.sum(0) + smooth) / (sizes.sum() + 2 * smooth)
        by = np.abs(toxic - clean) / np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
        sure[lo:lo + _RANGE] = np.where(some.sum(0) < 3, 0, by)
    most = min(FEATURES, max(LEAST_FEATURES, int((sure > EVIDENCE).sum())))
    least = np.partition(sure, BUCKETS - most)[BUCKETS - most]
    near = np.flatnonzero(sure >= least)
    best = np.sort(near[np.argsort(-sure[near], kind="stable")][:most])
    best = best[sure[best] > 0]
    clean, toxic = (counts[:, best] + smooth) / (sizes + 2 * smooth)[:, None]
    return best, np.log(toxic / clean)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, smooth: float = 1.0) -> Model:
    """A classifier from the labelled rows that aren't held out."""
    rows = saved(training_rows(docs, labels), "training")
    counts, sizes = _counted(rows)
    share = float((sizes[1] + 0.5) / (sizes.sum() + 1))
    if not sizes.all():
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    best, ratio = _chosen(counts, sizes, smooth)
    del counts
    model = Model(best, ratio, 0.0)
    part = most_rows / float(sizes.sum())
    some = rows if part >= 1 else rows.where((F.pmod("row", F.lit(1 << 30)) < int(part * 0.95 * (1 << 30))))

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = model.keep()

        def out() -> Iterator[tuple]:
            for batch in parts:
                ids, toxic = batch.column("row").to_pylist(), batch.column("toxic").to_pylist()
                for start, texts in _rounds(batch.column("text").to_pylist()):
                    for k, s in enumerate(_sets(texts, keep)):
                        yield ids[start + k], toxic[start + k], s.astype("<i4").tobytes()

        yield from batches(_SAMPLE, out())

    sample = sorted(some.mapInArrow(features, "row long, toxic int, features binary").limit(most_rows).collect())
    sets = [np.frombuffer(r[2], "<i4") for r in sample]
    labels_of = np.array([r[1] for r in sample], np.float64)
    if not len(sample) or labels_of.min() == labels_of.max():
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    w, b = _fit(sets, labels_of, ratio)
    return Model(best, w * ratio, b)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Documents with their score from 0 to 1 in a further column (which replaces one of that name)."""
    docs = docs.drop(column)
    names = docs.columns

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, weights = model.keep(), model.weights
        for part in parts:
            z = np.full(part.num_rows, model.intercept)
            for start, texts in _rounds(part.column("text").to_pylist()):
                for k, s in enumerate(_sets(texts, keep)):
                    z[start + k] += weights[s].sum()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))],
                                             [*names, column])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def digests(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (score(rows, train(docs, labels))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
