"""Operator 13: document quality by a linear-chain conditional random field over lines.

Every line that isn't blank gets TEMPLATES features, each a binned figure of the line (length, shares of letter and sign
classes, words that repeat those just before, how often the line occurs in its document); the chain scores a line as
good by its own bins and by those of the line before and the line after, and each pair of neighbours by a 2 x 2 table.
Forward-backward gives every line's marginal; their mean, weighted by the lines' code points, is the document's. As one
bad part of several makes a document bad, a logistic curve of two parameters turns that mean into the score.

The field is fitted by weighted likelihood on labelled documents, whose lines all carry the document's label: at most
``most_rows`` rows of each class, chosen by hash, that together have at most ``most_lines`` lines (rows of more than
``long_row`` lines are left out of the sample). Classes are weighted back to their shares among all training rows. Only
the sample's bins reach the driver, TEMPLATES + 8 bytes a line.

Messages are products of 2 x 2 matrices; they are taken for all lines of many documents at once by doubling the reach
of each product. The first line's matrix has equal rows, so nothing crosses from one document into the next.

Labels, languages, sources and ids are no inputs of a score. Null, empty and blank texts score the smoothed share of
good training rows, as all do where no row or only one class is labelled. Rows of ``labels`` with a null take no part; a
document with several labels is good if all say so. Repeated rows are scored one by one. A line is up to a line feed; a
text without one is one line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, batches, rounds, saved, slices, texts, words

THRESHOLD, MOST_ROWS, MOST_LINES, LONG_ROW = 0.3, 2048, 1 << 16, 4096
TEMPLATES, BINS = 14, 16
_OWN = TEMPLATES * BINS
#: Weights: own bins, bins of the line before, of the line after, first line, last line.
WEIGHTS = 3 * _OWN + 2
#: Ends of the bins of a share; bin 0 is exactly none.
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_BLOCK = 1 << 22
_SAMPLE = pa.schema([("row", pa.int64()), ("good", pa.int32()), ("n_lines", pa.int64()), ("sizes", pa.binary()),
                     ("bins", pa.binary())])

_FEED = np.arange(256) == 10
LOWER, UPPER, DIGIT, SPACE, POINT, CRY, BAR, SIGN, LEAD, REST = range(10)
_CLASS = np.full(256, SIGN, np.int64)
for _cls, _bytes in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, b" \t\n\x0b\x0c\r"),
                     (POINT, b".,;:'\"()-"), (CRY, b"!?"), (BAR, b"|/\\_"), (LEAD, range(192, 256)), (REST, range(128, 192))):
    _CLASS[list(_bytes)] = _cls


def held_out(doc_id: Column) -> Column:
    """Rows that the field doesn't learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Lines:
    """Lines that aren't blank of some rows: each line's row, code points and bins."""
    row: np.ndarray
    size: np.ndarray
    bins: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.diff(self.row, prepend=-1) != 0

    @property
    def last(self) -> np.ndarray:
        return np.diff(self.row, append=-1) != 0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.digitize(part / np.maximum(whole, 1), SHARES, right=True)


def lines(buf: np.ndarray, off: np.ndarray) -> Lines:
    """The lines of rows given as bytes and offsets."""
    n_rows = len(off) - 1
    joined = np.full(len(buf) + n_rows, 10, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[off[1:] + np.arange(n_rows)] = False
    joined[keep] = buf
    whole = np.array([0, len(joined)])
    h, a, b, _ = words(joined, whole, _FEED)
    row = np.searchsorted(off[1:] + np.arange(n_rows), a, "left")
    ends = np.cumsum(b - a)
    counts = np.zeros((len(a), 10), np.int64)
    classes = _CLASS[joined[joined != 10]] if len(joined) <= _BLOCK else None
    inside = np.flatnonzero(joined != 10) if classes is None else None
    for lo in range(0, int(ends[-1]) if len(ends) else 0, _BLOCK):
        hi = min(lo + _BLOCK, int(ends[-1]))
        some = classes[lo:hi] if classes is not None else _CLASS[joined[inside[lo:hi]]]
        of = np.searchsorted(ends, np.arange(lo, hi), "right")
        base = int(of[0])
        got = np.bincount((of - base) * 10 + some, minlength=(int(of[-1]) - base + 1) * 10).reshape(-1, 10)
        counts[base:base + len(got)] += got
    full = counts.sum(axis=1) > counts[:, SPACE]
    h, a, b, row, counts = h[full], a[full], b[full], row[full], counts[full]

    wh, wa, wb, _ = words(joined, whole, WHITE)
    at = np.searchsorted(a, wa, "right") - 1
    n_words = np.bincount(at, minlength=len(a))
    word_bytes = np.bincount(at, wb - wa, minlength=len(a))

    def again(*steps: int) -> np.ndarray:
        same = np.zeros(len(wh), bool)
        for k in steps:
            same[k:] |= (wh[k:] == wh[:-k]) & (at[k:] == at[:-k])
        return np.bincount(at[same], minlength=len(a))

    order = np.lexsort((h, row))
    edge = np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(h[order], prepend=h[order[:1]]) != 0))
    copies = np.empty(len(a), np.int64)
    copies[order] = np.repeat(np.diff(np.append(edge, len(a))), np.diff(np.append(edge, len(a))))

    size = counts.sum(axis=1) - counts[:, REST]
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, LEAD]
    bins = np.stack([
        np.log2(1 + size), _share(counts[:, UPPER], letters), _share(counts[:, DIGIT], size), _share(counts[:, CRY], size),
        _share(counts[:, BAR], size), _share(counts[:, SIGN], size), _share(counts[:, POINT], size), _share(letters, size),
        np.log2(1 + n_words), word_bytes / np.maximum(n_words, 1), _share(again(1), n_words), _share(again(2, 3), n_words),
        copies, _share(counts[:, LEAD], size)], axis=1)
    return Lines(row, size, np.clip(bins, 0, BINS - 1).astype(np.uint8))


@dataclass(frozen=True)
class Field:
    """Weights of good against bad lines, log potentials of neighbours (from bad, good to bad, good), the share of good
    rows, and the curve from mean to score."""
    weights: np.ndarray
    pairs: np.ndarray
    share: float
    fitted: bool
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, x: Lines) -> np.ndarray:
        own, before, after = self.weights[:3 * _OWN].reshape(3, _OWN)
        ids = x.bins + np.arange(TEMPLATES) * BINS
        first, last = x.first, x.last
        out = own[ids].sum(axis=1) + np.where(first, self.weights[-2], 0) + np.where(last, self.weights[-1], 0)
        out[1:] += np.where(first[1:], 0, before[ids[:-1]].sum(axis=1))
        out[:-1] += np.where(last[:-1], 0, after[ids[1:]].sum(axis=1))
        return np.clip(out, -40, 40)

    def quality(self, x: Lines, n_rows: int) -> np.ndarray:
        """Score of each row."""
        out = np.full(n_rows, self.share)
        if self.fitted and len(x.row):
            good = messages(self.scores(x), self.pairs, x.first, x.last)[0]
            total = np.bincount(x.row, x.size, n_rows)
            some = total > 0
            mean = np.bincount(x.row, x.size * good, n_rows)[some] / total[some]
            out[some] = 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.shift, -700, 700)))
        return out


def _logit(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _curve(z: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (at least 0) and shift of the likeliest logistic curve, by Newton steps from the identity."""
    design, w = np.stack([z, np.ones(len(z))], axis=1), weight / weight.sum()
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (w * (p - good)) + ridge * (theta - [1.0, 0.0])
        theta = theta - np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
    return max(0.0, float(theta[0])), float(theta[1])


def _reach(m: np.ndarray, longest: int, left: bool) -> np.ndarray:
    """Products of the matrices up to each place (``left``) or from it on, over at least ``longest`` places."""
    m, d = m / m.max(axis=(1, 2), keepdims=True), 1
    while d < longest:
        a, b = (m[:-d], m[d:])
        product = np.stack([a[:, 0, 0] * b[:, 0, 0] + a[:, 0, 1] * b[:, 1, 0], a[:, 0, 0] * b[:, 0, 1] + a[:, 0, 1] * b[:, 1, 1],
                            a[:, 1, 0] * b[:, 0, 0] + a[:, 1, 1] * b[:, 1, 0], a[:, 1, 0] * b[:, 0, 1] + a[:, 1, 1] * b[:, 1, 1]],
                           axis=1).reshape(-1, 2, 2)
        product /= product.max(axis=(1, 2), keepdims=True)
        m = np.concatenate([m[:d], product] if left else [product, m[-d:]])
        d *= 2
    return m


def messages(s: np.ndarray, pairs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good for each line, and of (bad, good) x (bad, good) for it and the next (zero after a last line)."""
    longest = int(np.diff(np.append(np.flatnonzero(first), len(s))).max())
    emit = np.exp(np.stack([np.zeros(len(s)), s], axis=1) - np.maximum(s, 0)[:, None])
    table = np.exp(pairs - pairs.max())
    step = table[None] * emit[:, None, :]
    into = np.where(first[:, None, None], emit[:, None, :], step)
    alpha = _reach(into, longest, True)[:, 0, :]
    alpha = alpha / alpha.sum(axis=1, keepdims=True)
    out = np.ones((len(s), 2, 2))
    out[:-1] = np.where(last[:-1, None, None], 1.0, step[1:])
    beta = _reach(out, longest, False)[:, :, 0]
    beta = beta / beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    joint = np.zeros((len(s), 2, 2))
    joint[:-1] = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
    joint[last] = 0
    total = joint.sum(axis=(1, 2), keepdims=True)
    return good, np.divide(joint, total, out=np.zeros_like(joint), where=total > 0)


def fit(x: Lines, good: np.ndarray, weight: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 250, rate: float = 0.1) -> Field:
    """A field for lines whose rows are labelled ``good`` and count ``weight``; sums run in a fixed order."""
    first, last = x.first, x.last
    y, w = good[x.row].astype(np.float64), weight[x.row] / weight[x.row].sum()
    ids = x.bins + np.arange(TEMPLATES) * BINS
    same = ~last
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[same].astype(int), y[same].astype(int)), w[same])
    theta, mean, square = np.zeros(WEIGHTS + 4), np.zeros(WEIGHTS + 4), np.zeros(WEIGHTS + 4)
    for t in range(1, steps + 1):
        field = Field(theta[:WEIGHTS], theta[WEIGHTS:].reshape(2, 2), share, True)
        p, joint = messages(field.scores(x), field.pairs, first, last)
        gap = w * (p - y)
        before, after = np.where(first, 0, gap)[1:], np.where(last, 0, gap)[:-1]
        grad = np.concatenate([
            np.bincount(ids.ravel(), np.repeat(gap, TEMPLATES), _OWN), np.bincount(ids[:-1].ravel(), np.repeat(before, TEMPLATES), _OWN),
            np.bincount(ids[1:].ravel(), np.repeat(after, TEMPLATES), _OWN), [gap[first].sum(), gap[last].sum()],
            ((joint * w[:, None, None]).sum(axis=0) - seen).ravel()]) + ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        theta = theta - rate * (1 - t / (steps + 1)) * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    return Field(theta[:WEIGHTS], theta[WEIGHTS:].reshape(2, 2), share, True)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, good (0 or 1) and a hash of each labelled row that isn't held out."""
    known = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("good")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Both sides are sorted at any size: labels cover a share of the documents.
    return (rows.where(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
            .select("text", "good", F.xxhash64(F.lit(13), "doc_id", "text").alias("row")))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_lines: int = MOST_LINES, long_row: int = LONG_ROW) -> Field:
    rows = saved(training_rows(docs, labels), "lines")
    sizes = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    nothing = Field(np.zeros(WEIGHTS), np.zeros((2, 2)), share, False)
    if len(sizes) < 2:
        return nothing
    # A little over ``most_rows`` of each class by hash; the limit below then keeps those of the smallest hashes.
    some = F.lit(False)
    for good, n in sizes.items():
        some |= (F.col("good") == good) & (F.pmod("row", F.lit(1 << 30)) < int(min(1.0, 1.2 * most_rows / n) * (1 << 30)))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for part in slices(parts):
                ids, good = part.column("row").to_pylist(), part.column("good").to_pylist()
                buf, off = texts(part.column("text"))
                for lo, hi in rounds(off):
                    x = lines(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    ends = np.searchsorted(x.row, np.arange(hi - lo + 1))
                    for k in range(hi - lo):
                        n = int(ends[k + 1] - ends[k])
                        if 0 < n <= long_row:
                            yield ids[lo + k], good[lo + k], n, x.size[ends[k]:ends[k + 1]].astype("<i8").tobytes(), x.bins[ends[k]:ends[k + 1]].tobytes()

        yield from batches(_SAMPLE, out())

    bins = saved(rows.where(some).mapInArrow(work, "row long, good int, n_lines long, sizes binary, bins binary"), "sample")
    label, weight, row, size, held = [], [], [], [], []
    for good, n in sorted(sizes.items()):
        picked, left = [], most_lines // 2
        ordered = bins.where(F.col("good") == good).orderBy(F.pmod("row", F.lit(1 << 30)), "row", "bins").limit(most_rows)
        for r in ordered.toLocalIterator():
            if r["n_lines"] > left:
                break
            left -= r["n_lines"]
            picked.append((bytes(r["sizes"]), bytes(r["bins"])))
        for lengths, one in picked:
            label.append(good)
            weight.append(n / len(picked))
            size.append(np.frombuffer(lengths, "<i8"))
            held.append(np.frombuffer(one, np.uint8).reshape(-1, TEMPLATES))
            row.append(np.full(len(held[-1]), len(label) - 1))
    if len(set(label)) < 2:
        return nothing
    x = Lines(np.concatenate(row), np.concatenate(size), np.concatenate(held))
    good, weight = np.array(label), np.array(weight)
    field = fit(x, good, weight, share)
    marginal = messages(field.scores(x), field.pairs, x.first, x.last)[0]
    mean = np.bincount(x.row, x.size * marginal) / np.bincount(x.row, x.size)
    slope, shift = _curve(_logit(mean), good, weight)
    return replace(field, slope=slope, shift=shift)


def score(docs: DataFrame, field: Field, column: str = "score") -> DataFrame:
    """Documents with their quality from 0 to 1 in a further column (which replaces one of that name)."""
    docs = docs.drop(column)
    names = docs.columns

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            buf, off = texts(part.column(names.index("text")))
            out = np.empty(part.num_rows)
            for lo, hi in rounds(off):
                out[lo:hi] = field.quality(lines(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*names, column])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def line_marginals(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (number among the lines that aren't blank, from 0), size in code points, and good (its marginal)."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("size", pa.int64()), ("good", pa.float64())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            ids = part.column(0)
            buf, off = texts(part.column(1))
            for lo, hi in rounds(off):
                x = lines(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                if len(x.row):
                    good = messages(field.scores(x), field.pairs, x.first, x.last)[0]
                    start = np.flatnonzero(x.first)
                    number = np.arange(len(x.row)) - np.repeat(start, np.diff(np.append(start, len(x.row))))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + x.row)), pa.array(number), pa.array(x.size), pa.array(good)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, line long, size long, good double")


def digests(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (score(rows, train(docs, labels))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
