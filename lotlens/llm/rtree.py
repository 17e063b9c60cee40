"""Operator 11: hard negatives by best-first search in STR-packed R-trees.

Integer vectors are dealt out by label and first coordinate, and packed by Sort-Tile-Recursive into trees of at most
CHUNK rows: sorted by label, then cut into slabs coordinate by coordinate, widest first, until a tile is a leaf; FAN
neighbours share a parent. Each box holds the least and greatest value of every coordinate and label, so the inner
product with a vector lies in the sum of the intervals of its coordinates.

A block of queries goes through a tree with one best-first queue: the box whose upper bound, cut to the windows, is
the highest comes first. A query takes part in a box while the box may hold its label (or, for negatives, another) and
one of its windows of scores meets the box's interval and isn't full of scores strictly above it; a box that no query
of the block needs is pruned with all below it. Ties at a k-th score are searched, so ids decide them exactly. Where
vectors don't cluster, 64 coordinates leave hardly a box to prune, and the search becomes one of all rows by matrix
products, leaf by leaf; results are the same.

Trees and blocks meet in a grid of cells: blocks are copied once for each column, trees once for each row. A task holds
the blocks of its cell (CELL_BLOCKS or so) and one tree at a time. Each cell gives at most ``k`` rows for a window, and
these meet in one ranking for each window, so no task sees all of a query's candidates.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Components are
held in +-2^26 and products are exact up to 1,024 of them. Vectors meet those of their own length. A query meets no row
with its own id; repeated rows are candidates each; anchors that agree in id, label and vector are one. Further columns
don't matter. Empty tables give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, saved

CHUNK, LEAF, FAN, QUERY_BLOCK, CELL_BLOCKS = 16_384, 128, 16, 256, 64
_LARGEST = 1 << 26
_ANY, _NONE = -(1 << 62), -(1 << 62) - 1

_TREE = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                   ("data", pa.binary()), ("boxes", pa.binary()), ("nodes", pa.binary())])
_TREE_DDL = "part long, dim int, ids binary, labels binary, data binary, boxes binary, nodes binary"
_BLOCK = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()),
                    ("labels", pa.binary()), ("data", pa.binary()), ("windows", pa.binary())])
_BLOCK_DDL = "part long, dim int, keys binary, ids binary, labels binary, data binary, windows binary"
_FOUND = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64())])


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, dim and v (floor(scale * x) of each component) of the rows that take part."""
    part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("_e"))
    fine = F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-_LARGEST))), F.lit(float(_LARGEST)))).cast("int")
    return (part.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("_e") > 0) & fine)
            .select("vec_id", "label", F.size("_e").alias("dim"), F.transform("_e", whole).alias("v")))


def _str_order(v: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in packing order: by label, and each label's rows tiled coordinate by coordinate, the widest first."""
    first = np.lexsort((v[:, 0], labels))
    out = []

    def tile(rows: np.ndarray, axes: np.ndarray) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or not len(axes):
            out.append(rows)
            return
        rows = rows[np.argsort(v[rows, axes[0]], kind="stable")]
        slabs = max(2, int(np.ceil(pages ** (1 / len(axes)))))
        wide = -(-pages // slabs) * leaf
        for lo in range(0, len(rows), wide):
            tile(rows[lo:lo + wide], axes[1:])

    for rows in np.split(first, np.flatnonzero(np.diff(labels[first])) + 1):
        tile(rows, np.argsort(-v[rows].std(axis=0), kind="stable"))
    return np.concatenate(out)


@dataclass(frozen=True)
class Tree:
    """Nodes from the leaves up: ``lo`` and ``hi`` of the coordinates, least and greatest label, first and end child."""
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    nodes: np.ndarray
    leaves: int
    roots: int

    @classmethod
    def pack(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
        order = _str_order(v, labels, leaf)
        ids, labels, v = ids[order], labels[order], v[order]
        first = np.arange(0, len(ids), leaf)
        lo, hi = [np.minimum.reduceat(v, first)], [np.maximum.reduceat(v, first)]
        nodes = [np.stack([np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first), first,
                           np.append(first[1:], len(ids))], axis=1)]
        base = 0
        while len(nodes[-1]) > fan:
            first, below = np.arange(0, len(nodes[-1]), fan), nodes[-1]
            lo.append(np.minimum.reduceat(lo[-1], first))
            hi.append(np.maximum.reduceat(hi[-1], first))
            nodes.append(np.stack([np.minimum.reduceat(below[:, 0], first), np.maximum.reduceat(below[:, 1], first),
                                   base + first, base + np.append(first[1:], len(below))], axis=1))
            base += len(below)
        return cls(ids, labels, v, np.concatenate(lo), np.concatenate(hi), np.concatenate(nodes), len(nodes[0]), len(nodes[-1]))

    def row(self, part: int) -> tuple:
        boxes = np.concatenate([self.lo, self.hi]).astype("<i4")
        nodes = np.concatenate([[[self.leaves, self.roots, 0, 0]], self.nodes]).astype("<i8")
        return (part, self.v.shape[1], self.ids.astype("<i8").tobytes(), self.labels.astype("<i8").tobytes(),
                self.v.astype("<i4").tobytes(), boxes.tobytes(), nodes.tobytes())

    @classmethod
    def read(cls, row: dict) -> Tree:
        boxes = np.frombuffer(row["boxes"], "<i4").reshape(2, -1, row["dim"])
        nodes = np.frombuffer(row["nodes"], "<i8").reshape(-1, 4)
        return cls(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"),
                   np.frombuffer(row["data"], "<i4").reshape(-1, row["dim"]), boxes[0], boxes[1], nodes[1:],
                   int(nodes[0, 0]), int(nodes[0, 1]))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def _lists(column: pa.ListArray) -> np.ndarray:
    out = np.empty(len(column), object)
    for i, s in enumerate(column.to_pylist()):
        out[i] = s
    return out


def _runs(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of one length, ``most`` at a time, as arrays of the columns (the vectors' is ``v``, their length ``dim``)."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for part in parts:
        names = part.schema.names
        dims = np.asarray(part.column(names.index("dim")))
        for dim in np.unique(dims).tolist():
            some = part.filter(pa.array(dims == dim))
            for at in range(0, some.num_rows, most):
                piece = some.slice(at, most)
                arrays = [_matrix(c) if n == "v" else _lists(c) if n == "scores" else np.asarray(c.to_numpy(zero_copy_only=False)) for n, c in zip(names, piece.columns, strict=True)]
                kept = held.setdefault(dim, [])
                kept.append(arrays)
                while sum(len(a[0]) for a in kept) >= most:
                    whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
                    yield dim, [x[:most] for x in whole]
                    kept[:] = [[x[most:] for x in whole]] if len(whole[0]) > most else []
    for dim, kept in held.items():
        if kept:
            yield dim, [np.concatenate(x) for x in zip(*kept, strict=True)]


def index(rows: DataFrame, chunk: int = CHUNK, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """The trees over ``quantised`` rows, one a row. The id among the keys of the range splits labels and repeated vectors."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def out() -> Iterator[tuple]:
            for k, (_, (ids, labels, _, v)) in enumerate(_runs(parts, chunk)):
                yield Tree.pack(ids, labels, v, leaf, fan).row(number + k)

        yield from batches(_TREE, out(), most=16)

    dealt = rows.repartitionByRange("dim", "label", F.col("v")[0], "vec_id").sortWithinPartitions("dim", "label", F.col("v")[0], "vec_id")
    return dealt.select("vec_id", "label", "dim", "v").mapInArrow(work, _TREE_DDL)


def _windows(scores: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores that are at least and at most these hundredths of the given ones, without leaving 64 bits."""
    whole, rest = scores // 100, scores % 100
    low, high = share
    return whole * low - (-rest * low // 100), whole * high + rest * high // 100


def _blocks(queries: DataFrame, share: tuple[int, int] | None, size: int) -> DataFrame:
    """Queries (key, vec_id, label, dim, v, scores) in blocks; a window of scores for each of ``scores``, or one of all."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def out() -> Iterator[tuple]:
            for k, (dim, (keys, ids, labels, _, v, scores)) in enumerate(_runs(parts, size)):
                width = max(1, max(len(s) for s in scores))
                lo, hi = np.full((len(keys), width), -_ANY, np.int64), np.full((len(keys), width), _ANY, np.int64)
                for i, s in enumerate(scores):
                    if share is None:
                        lo[i], hi[i] = _ANY, -_ANY
                    elif s:
                        lo[i, :len(s)], hi[i, :len(s)] = _windows(np.array(s, np.int64), share)
                yield (number + k, dim, keys.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(),
                       v.astype("<i4").tobytes(), np.stack([lo, hi]).astype("<i8").tobytes())

        yield from batches(_BLOCK, out(), most=64)

    dealt = queries.repartitionByRange("dim", "label", F.col("v")[0], "vec_id", "key").sortWithinPartitions("dim", "label", F.col("v")[0], "vec_id")
    return dealt.select("key", "vec_id", "label", "dim", "v", "scores").mapInArrow(work, _BLOCK_DDL)


class Block:
    """Queries with the best ``k`` rows of each window so far; ``floor`` is the least score that a window still takes."""

    def __init__(self, row: dict, k: int, same: bool):
        self.keys, self.ids, self.labels = (np.frombuffer(row[n], "<i8") for n in ("keys", "ids", "labels"))
        self.q = np.frombuffer(row["data"], "<i4").reshape(-1, row["dim"])
        self.low, self.high = np.frombuffer(row["windows"], "<i8").reshape(2, len(self.keys), -1)
        self.same, self.k = same, k
        self.floor = self.low.copy()
        self.best = np.full((*self.low.shape, k), _NONE, np.int64)
        self.who = np.zeros((*self.low.shape, k), np.int64)
        self.visited = self.pruned = 0

    def search(self, tree: Tree) -> None:
        most = int(np.abs(self.q).max()) * max(int(np.abs(tree.lo).max()), int(np.abs(tree.hi).max())) * self.q.shape[1]
        kind, far = (np.float32, 1 << 24) if most < 1 << 24 else (np.float64, 1 << 53) if most < 1 << 53 else (np.int64, 1 << 62)
        q, v = self.q.astype(kind), tree.v.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)

        def edge(x: np.ndarray) -> np.ndarray:  # no score lies beyond ``far``, so cutting a window there changes nothing
            return np.clip(x, -far, far).astype(kind)

        def needed(top: np.ndarray, low: np.ndarray) -> np.ndarray:
            out = np.zeros(top.shape, bool)
            for w in range(self.low.shape[1]):
                out |= (top >= edge(self.floor[:, w])[:, None]) & (low <= edge(self.high[:, w])[:, None])
            return out

        highest = edge(self.high.max(axis=1))
        queue: list[tuple] = []

        def offer(nodes: np.ndarray, above: np.ndarray) -> None:
            lo, hi = tree.lo[nodes].astype(kind).T, tree.hi[nodes].astype(kind).T
            top, low = up @ hi + down @ lo, up @ lo + down @ hi
            first, last = tree.nodes[nodes, 0], tree.nodes[nodes, 1]
            own = self.labels[:, None]
            may = ((first <= own) & (own <= last)) if self.same else ((first != own) | (last != own))
            live = above[:, None] & may & needed(top, low)
            rank = np.where(live, np.minimum(top, highest[:, None]), -far - 1).max(axis=0)
            for j in range(len(nodes)):
                if live[:, j].any():
                    heapq.heappush(queue, (-int(rank[j]), int(nodes[j]), top[:, j], low[:, j], live[:, j]))
                else:
                    self.pruned += 1

        count = len(tree.nodes)
        offer(np.arange(count - tree.roots, count), np.ones(len(q), bool))
        while queue:
            _, node, top, low, live = heapq.heappop(queue)
            live = live & needed(top[:, None], low[:, None])[:, 0]
            if not live.any():
                self.pruned += 1
                continue
            self.visited += 1
            first, last, a, b = tree.nodes[node].tolist()
            if node >= tree.leaves:
                offer(np.arange(a, b), live)
                continue
            at = np.flatnonzero(live)
            s = q[at] @ v[a:b].T
            ids, fit = tree.ids[a:b], None
            if first != last:
                fit = (tree.labels[a:b] == self.labels[at][:, None]) == self.same
            if np.isin(ids, self.ids).any():
                other = ids != self.ids[at][:, None]
                fit = other if fit is None else fit & other
            for w in range(self.low.shape[1]):
                hit = (s >= edge(self.floor[at, w])[:, None]) & (s <= edge(self.high[at, w])[:, None])
                x, j = np.nonzero(hit if fit is None else hit & fit)
                if len(x):
                    self._add(at[x], w, s[x, j].astype(np.int64), ids[j])

    def _add(self, at: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        rows, k = np.unique(at), self.k
        at = np.concatenate([at, np.repeat(rows, k)])
        score = np.concatenate([score, self.best[rows, w].ravel()])
        ids = np.concatenate([ids, self.who[rows, w].ravel()])
        order = np.lexsort((ids, -score, at))
        start = np.searchsorted(at[order], rows)
        keep = order[(start[:, None] + np.arange(k)).ravel()]  # every row brings the k it had
        self.best[rows, w] = score[keep].reshape(-1, k)
        self.who[rows, w] = ids[keep].reshape(-1, k)
        self.floor[rows, w] = np.maximum(self.low[rows, w], self.best[rows, w, -1])

    def found(self) -> Iterator[tuple]:
        for i, w, n in np.argwhere(self.best != _NONE).tolist():
            yield int(self.keys[i]), w, int(self.best[i, w, n]), int(self.who[i, w, n])


def search(trees: DataFrame, queries: DataFrame, k: int, same: bool, share: tuple[int, int] | None = None,
           block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest scores of every window of every query: key, place of the window, score, found_id.

    ``trees`` is a written ``index``; queries have key, vec_id, label, dim, v and scores. Rows found have the query's
    label (``same``) or another. With ``share`` each of ``scores`` opens a window from ``share[0]`` to ``share[1]``
    hundredths of it, else one window takes all.
    """
    blocks = saved(_blocks(queries, share, block), "blocks")
    spark = blocks.sparkSession
    n_trees, n_blocks = trees.count(), blocks.count()
    cells = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_trees * n_blocks))
    # Copies are fewest where both sides are copied about as many bytes; the blocks of a cell stay few.
    rows = max(round((cells * n_blocks * block / max(1, n_trees * CHUNK)) ** 0.5), -(-n_blocks // CELL_BLOCKS), 1)
    columns = max(1, -(-cells // rows))

    def dealt(side: DataFrame, kind: int, mine: str, n: int, others: str, m: int) -> DataFrame:
        return (side.withColumn(mine, F.pmod(F.xxhash64("part"), F.lit(n)).cast("int"))
                .withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("kind", F.lit(kind)))

    met = (dealt(blocks, 0, "row", rows, "column", columns)
           .unionByName(dealt(trees, 1, "column", columns, "row", rows), allowMissingColumns=True)
           .repartition(rows * columns, "dim", "row", "column").sortWithinPartitions("dim", "row", "column", "kind", "part")
           .select("dim", "row", "column", "kind", "keys", "ids", "labels", "data", "windows", "boxes", "nodes"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            cell, held = None, []
            for part in parts:
                for i in range(part.num_rows):
                    row = {n: c[i].as_py() for n, c in zip(part.schema.names, part.columns, strict=True)}
                    if (row["dim"], row["row"], row["column"]) != cell:
                        for b in held:
                            yield from b.found()
                        cell, held = (row["dim"], row["row"], row["column"]), []
                    if row["kind"] == 0:
                        held.append(Block(row, k, same))
                    elif held:
                        tree = Tree.read(row)
                        for b in held:
                            b.search(tree)
            for b in held:
                yield from b.found()

        yield from batches(_FOUND, out())

    found = met.mapInArrow(work, "key long, place int, score long, found_id long")
    best = Window.partitionBy("key", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   share: tuple[int, int] = (50, 95), scale: float = 256.0) -> DataFrame:
    """Of every anchor and each of its best positives (same label), the best rows of other labels whose score is from
    ``share[0]`` to ``share[1]`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, positive_rank."""
    rows = saved(quantised(vectors, scale), "vectors")
    trees = saved(index(rows), "trees")
    anchors = saved(rows.where(anchor).distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    asked = anchors.withColumn("scores", F.array().cast("array<long>"))
    near = saved(search(trees, asked, positives, same=True), "positives")
    # At most ``positives`` scores an anchor.
    listed = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("_s"))
    asked = anchors.join(listed, "key").select(*anchors.columns, F.col("_s.score").alias("scores"))
    far = search(trees, asked, negatives, same=False, share=share)
    return (far.select("key", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("found_id").alias("negative_id"),
                       F.col("score").alias("negative_score"))
            .join(near.select("key", F.col("rank").alias("positive_rank"), F.col("found_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), ["key", "positive_rank"])
            .join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"))
