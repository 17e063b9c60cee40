"""Operator 1: exact top-k search by distributed histogram selection.

All queries are scored against all vectors, in blocks: a block of queries meets
every chunk of vectors once in each pass. A pass counts each query's scores in
BINS intervals of its current range; the interval that holds the k-th best
score becomes the next range. When ranges are one score wide, the k-th score of
each query is known with the number of ties to take, and a last pass keeps the
scores above it and of each chunk the smallest ids at it. Only counts and these
rows are shuffled, never scores.

Vectors are integers (``quantised``: floor(scale * x) of each component, x as
double). Null vectors, empty ones, and those with a null or non-finite
component take no part, nor do rows without id. A vector meets those of its own
length. Repeated rows are candidates each; a query doesn't meet rows with its
own id. Scores beyond a long wrap around as a long does. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, saved

BINS, QUERY_BLOCK, CHUNK = 128, 512, 8192
_ALL = -(1 << 62)

_PACKED = pa.schema([("part", pa.int64()), ("dim", pa.int64()), ("norm", pa.float64()), ("ids", pa.binary()),
                     ("data", pa.binary()), ("bytes", pa.int64())])
_PACKED_DDL = "part long, dim long, norm double, ids binary, data binary, bytes long"
_COUNTS = pa.schema([("part", pa.int64()), ("counts", pa.binary())])
_STATE = pa.schema([("part", pa.int64()), ("state", pa.binary())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def packed(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """(vec_id, embedding) as matrices of at most ``rows`` integer vectors of one length."""
    def quantised(part: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        ids, column = part.column(0), part.column(1).cast(pa.large_list(pa.float64()))
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        flat = column.values.slice(off[0], off[-1] - off[0])
        x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
        n, start = np.diff(off), off[:-1] - off[0]
        fine = np.asarray(pc.and_(pc.is_valid(ids), pc.is_valid(column)).to_numpy(zero_copy_only=False)) & (n > 0)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        fine &= bad[start + n] == bad[start]
        ids = np.asarray(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.int64)
        for dim in np.unique(n[fine]).tolist():
            rows_of = np.flatnonzero(fine & (n == dim))
            v = np.floor(scale * x[start[rows_of][:, None] + np.arange(dim)])
            yield ids[rows_of], np.clip(v, -2.0 ** 62, 2.0 ** 62).astype(np.int64)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            held: dict[int, list] = {}
            number = TaskContext.get().partitionId() << 32

            def one(dim: int, ids: np.ndarray, v: np.ndarray) -> tuple:
                nonlocal number
                number += 1
                most = int(np.abs(v).max())
                width = 1 if most < 128 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max()))
                return number, dim, norm, ids.astype("<i8").tobytes(), v.astype(f"<i{width}").tobytes(), width

            for part in parts:
                for lo in range(0, part.num_rows, rows):
                    for ids, v in quantised(part.slice(lo, rows)):
                        held.setdefault(v.shape[1], []).append((ids, v))
                        while sum(len(i) for i, _ in held[v.shape[1]]) >= rows:
                            ids, v = (np.concatenate(x) for x in zip(*held[v.shape[1]], strict=True))
                            held[v.shape[1]] = [(ids[rows:], v[rows:])] if len(ids) > rows else []
                            yield one(v.shape[1], ids[:rows], v[:rows])
            for dim, some in held.items():
                if some:
                    yield one(dim, *(np.concatenate(x) for x in zip(*some, strict=True)))

        yield from batches(_PACKED, out(), most=64)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(work, _PACKED_DDL)


def _matrix(ids: bytes, data: bytes, width: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, f"<i{width}").reshape(-1, dim)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where every sum is an integer that they hold."""
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(v.astype(np.float64)).max()) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)


class _Block:
    """A block of queries with each query's range: ``span`` scores from ``low`` on, in intervals ``wide`` each; ``need``:
    which score of the range is sought."""

    def __init__(self, row: dict):
        self.part = row["q_part"]
        self.ids, self.q = _matrix(row["q_ids"], row["q_data"], row["q_bytes"], row["dim"])
        self.low, self.wide, self.need, self.span = np.frombuffer(row["state"], "<i8").reshape(4, -1)
        self.counts = np.zeros((len(self.ids), BINS), np.int64)

    def scored(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, v = _matrix(row["ids"], row["data"], row["bytes"], row["dim"])
        return ids, _scores(self.q, v), self.ids[:, None] != ids

    def count(self, row: dict) -> None:
        _, s, other = self.scored(row)
        s -= self.low[:, None]
        fit = other & (s >= 0) & (s < self.span[:, None])
        at = s // self.wide[:, None]
        at += np.arange(len(at))[:, None] * BINS
        self.counts += np.bincount(at[fit], minlength=self.counts.size).reshape(self.counts.shape)

    def hits(self, row: dict) -> Iterator[tuple]:
        ids, s, other = self.scored(row)
        above = other & (s > self.low[:, None])
        for k, j in np.argwhere(above).tolist():
            yield int(self.ids[k]), int(ids[j]), int(s[k, j])
        ties = other & (s == self.low[:, None])
        for k in np.flatnonzero(ties.any(1) & (self.need > 0)).tolist():
            tied, need = ids[ties[k]], int(self.need[k])
            for i in np.sort(np.partition(tied, need - 1)[:need] if len(tied) > need else tied).tolist():
                yield int(self.ids[k]), i, int(self.low[k])


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for k in range(part.num_rows):
            yield {n: c[k].as_py() for n, c in zip(part.schema.names, part.columns, strict=True)}


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[tuple]:
        blocks: dict[int, _Block] = {}
        for row in _rows(parts):
            if row["q_part"] not in blocks:
                if len(blocks) >= 64:
                    for b in blocks.values():
                        yield b.part, b.counts.astype("<i8").tobytes()
                    blocks.clear()
                blocks[row["q_part"]] = _Block(row)
            blocks[row["q_part"]].count(row)
        for b in blocks.values():
            yield b.part, b.counts.astype("<i8").tobytes()

    yield from batches(_COUNTS, out(), most=64)


def _add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of a block; the rows of one come one after the other."""
    def out() -> Iterator[tuple]:
        part, total = None, None
        for row in _rows(parts):
            counts = np.frombuffer(row["counts"], "<i8")
            if row["part"] != part:
                if part is not None:
                    yield part, total.astype("<i8").tobytes()
                part, total = row["part"], counts.copy()
            else:
                total += counts
        if part is not None:
            yield part, total.astype("<i8").tobytes()

    yield from batches(_COUNTS, out(), most=64)


def _narrow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next range of each query: the interval that holds the score it needs; all scores if they are too few."""
    def out() -> Iterator[tuple]:
        for row in _rows(parts):
            low, wide, need, _ = np.frombuffer(row["state"], "<i8").reshape(4, -1).copy()
            counts = np.frombuffer(row["counts"], "<i8").reshape(-1, BINS) if row["counts"] else np.zeros((len(low), BINS), np.int64)
            down = np.cumsum(counts[:, ::-1], axis=1)
            enough = down[:, -1] >= need
            k = np.argmax(down >= need[:, None], axis=1)
            over = np.where(k > 0, np.take_along_axis(down, np.maximum(k - 1, 0)[:, None], 1)[:, 0], 0)
            live = low != _ALL
            need = np.where(live & enough, need - over, np.where(live, 0, need))
            low = np.where(live & enough, low + (BINS - 1 - k) * wide, _ALL)
            yield row["part"], np.stack([low, -(-wide // BINS), need, wide]).astype("<i8").tobytes()

    yield from batches(_STATE, out(), most=64)


def _hits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[tuple]:
        for row in _rows(parts):
            yield from _Block(row).hits(row)

    yield from batches(_HITS, out())


def search(queries: DataFrame, vectors: DataFrame, k: int, scale: float = 64.0) -> DataFrame:
    """Each query's ``k`` highest scores: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Both tables have vec_id and embedding.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = saved(packed(vectors, scale, CHUNK).withColumn("cell", F.pmod(F.xxhash64("part"), F.lit(cells)).cast("int")), "chunks")
    chunks = chunks.drop("part")
    blocks = packed(queries, scale, QUERY_BLOCK).select(
        F.col("part").alias("q_part"), "dim", F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"), F.col("bytes").alias("q_bytes"))
    blocks = saved(blocks, "queries")
    norms = chunks.groupBy("dim").agg(F.max("norm").alias("norm"))
    # No inner product exceeds the product of the norms; one row for each length of vectors.
    reach = (blocks.groupBy("dim").agg(F.max("q_norm").alias("q_norm")).join(norms, "dim")
             .agg(F.max(F.col("q_norm") * F.col("norm"))).first()[0]) or 0.0
    reach = int(min(reach * (1 + 1e-9) + 2, float(1 << 61)))
    wide = -(-(2 * reach + 1) // BINS)

    def begin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for row in _rows(parts):
                n = len(row["q_ids"]) // 8
                yield row["q_part"], np.repeat(np.array([-reach, wide, k, wide * BINS], "<i8"), n).tobytes()

        yield from batches(_STATE, out(), most=64)

    state = blocks.select("q_part", "q_ids").mapInArrow(begin, "part long, state binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")

    def met(state: DataFrame) -> DataFrame:
        asked = blocks.join(state.withColumnRenamed("part", "q_part"), "q_part").select("*", every)
        return chunks.join(asked, ["cell", "dim"])

    while True:
        counts = (met(state).mapInArrow(_count, "part long, counts binary")
                  .repartition("part").sortWithinPartitions("part").mapInArrow(_add, "part long, counts binary"))
        state = saved(state.join(counts, "part", "left").mapInArrow(_narrow, "part long, state binary"), "state")
        if wide == 1:
            break
        wide = -(-wide // BINS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met(state).mapInArrow(_hits, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
