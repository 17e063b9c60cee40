"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of runs of WIDTH words (letters, digits and non-ASCII characters, lower case); a shorter text is one
run of all its words. Two documents are linked if the Jaccard similarity of their sets reaches THRESHOLD.

* Documents with one set are one class of copies, found by its hash; all that follows works on one of them.
* Candidates agree in a band of ROWS MinHash values. A pair at the threshold is missed with probability
  (1 - 0.8^4)^24 = 3e-6, one above it more rarely.
* A pair of candidates is compared SLICE values at a time. After m matches of n, with a uniform prior, the similarity
  reaches the threshold with probability P(Bin(n + 1, threshold) <= m); below TOLERANCE the pair is dropped.
* What is left is verified exactly on the sets of runs (known by 48 bits of a hash each).

Near copies agree in most bands, so a group of them would be compared again in each. Every document therefore gets a
home: the largest bucket that it is in, or the home of most of that bucket's members. Pairs with one home are compared
there, each once; the rest in the first band in which they agree. Homes and buckets of any size are split into blocks
of bounded size, and each pair of blocks is a task's work: rows hold blocks, link counts and spanning edges, never the
pairs of a group. Components are found on the spanning edges.

Null and empty texts have no run, are linked to nothing and are a class each. Repeated rows are copies. Nothing is
dropped from a bucket, however large.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .common import PLAIN, batches, grams, rounds, saved, slices, text_rows, texts, words
from .components import components

WIDTH, THRESHOLD, ROWS, BANDS, SLICE, TOLERANCE = 5, 0.8, 4, 24, 32, 1e-6
HASHES = ROWS * BANDS
BLOCK_ROWS, BLOCK_RUNS = 1024, 1 << 20

_random = np.random.default_rng(20)
_A = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_FEATURES = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("set_id", pa.int64()), ("size", pa.int32()), ("signature", pa.binary())])
_OUT = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("grp", pa.int64()),
                  ("band", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("rows", pa.int32()),
                  ("sets", pa.binary()), ("copies", pa.binary()), ("homes", pa.binary()), ("signatures", pa.binary()),
                  ("sizes", pa.binary()), ("runs", pa.binary())])
_OUT_DDL = ("kind int, a long, b long, n long, grp long, band int, block int, blocks int, rows int, sets binary, "
            "copies binary, homes binary, signatures binary, sizes binary, runs binary")
_LINKS, _EDGE, _PAIR, _BLOCK = range(4)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct runs of each text."""
    buf, off = texts(pc.utf8_lower(column))
    for lo, hi in rounds(off):
        h, _, _, w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], PLAIN)
        every = grams(h, WIDTH)
        for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
            n = b - a
            yield np.unique(every[a:b - WIDTH + 1] if n >= WIDTH else grams(h[a:b], n) if n else h[:0])


def _signature(runs: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(runs), 2048):
        some = (runs[lo:lo + 2048, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, some.min(0).astype(np.uint32), out=out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, _h, set_id (null without words), size and MinHash signature of every document."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in slices(parts):
                keys = zip(part.column("doc_id").to_pylist(), part.column("_h").to_pylist(), strict=True)
                for (doc, h), runs in zip(keys, _sets(part.column("text")), strict=True):
                    if len(runs):
                        yield (doc, h, xxhash.xxh3_64_intdigest(runs.tobytes()) - (1 << 63), len(runs),
                               _signature(runs).astype("<u4").tobytes())
                    else:
                        yield doc, h, None, 0, None

        yield from batches(_FEATURES, rows())

    return text_rows(docs).select("doc_id", "_h", "text").mapInArrow(
        work, "doc_id long, _h long, set_id long, size int, signature binary")


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of matches among ``n`` values that leaves the threshold likely enough."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


class Block:
    """Some documents (one of each class) of a home or bucket."""

    def __init__(self, row: dict):
        n = row["rows"]
        self.sets, self.copies, self.homes = (np.frombuffer(row[k], "<i8") for k in ("sets", "copies", "homes"))
        self.signatures = np.frombuffer(row["signatures"], "<u4").reshape(n, HASHES)
        self.sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        data = row["runs"]
        if data:
            m = len(data) // 6
            self.runs = (np.frombuffer(data[:4 * m], "<u4").astype(np.uint64)
                         | (np.frombuffer(data[4 * m:], "<u2").astype(np.uint64) << np.uint64(32)))
            self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def bands(self) -> np.ndarray:
        x = self.signatures.reshape(len(self.sets), BANDS, ROWS).astype(np.uint64)
        out = np.zeros(x.shape[:2], np.uint64)
        for k in range(ROWS):
            out = (out + x[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        return out


def likely(x: Block, y: Block, allowed: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks that Bayesian pruning leaves, as positions."""
    matches = np.zeros(allowed.shape, np.int16)
    for k in range(SLICE):
        matches += x.signatures[:, k][:, None] == y.signatures[:, k]
    i, j = np.nonzero(allowed & (matches >= fewest_matches(SLICE, threshold, tolerance)))
    matches = matches[i, j]
    for lo in range(SLICE, HASHES, SLICE):
        hi = min(lo + SLICE, HASHES)
        more = np.concatenate([(x.signatures[i[p:p + 65536], lo:hi] == y.signatures[j[p:p + 65536], lo:hi]).sum(1)
                               for p in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
        matches = matches + more
        keep = matches >= fewest_matches(hi, threshold, tolerance)
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _common(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many runs the pairs share, exactly."""
    if len(i) < 2 * (len(x.sets) + len(y.sets)):
        return np.array([len(np.intersect1d(x.runs[x.first[a]:x.first[a + 1]], y.runs[y.first[b]:y.first[b + 1]], assume_unique=True))
                         for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    known = np.intersect1d(x.runs, y.runs)  # what either block has alone is shared by no pair
    at = []
    for z in (x, y):
        row = np.repeat(np.arange(len(z.sets)), z.sizes)
        k = np.minimum(np.searchsorted(known, z.runs), max(len(known) - 1, 0))
        fit = known[k] == z.runs if len(known) else np.zeros(len(z.runs), bool)
        order = np.argsort(k[fit], kind="stable")
        at.append((row[fit][order], k[fit][order]))
    out = np.zeros((len(x.sets), len(y.sets)), np.float32)
    for lo in range(0, len(known), 4096):
        some = []
        for z, (row, k) in zip((x, y), at, strict=True):
            a, b = np.searchsorted(k, [lo, lo + 4096])
            m = np.zeros((len(z.sets), min(4096, len(known) - lo)), np.float32)
            m[row[a:b], k[a:b] - lo] = 1
            some.append(m)
        out += some[0] @ some[1].T
    return out[i, j].astype(np.int64)


def linked(x: Block, y: Block, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of two blocks of a home."""
    allowed = np.ones((len(x.sets), len(y.sets)), bool)
    if same:
        allowed = np.triu(allowed, 1)
    i, j = likely(x, y, allowed, threshold, tolerance)
    if not len(i):
        return i, j
    shared = _common(x, y, i, j)
    keep = reached(shared, x.sizes[i], y.sizes[j], threshold)
    return i[keep], j[keep]


def reached(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return shared >= threshold * (a + b - shared) - 1e-9


def _home_rows(x: Block, y: Block, same: bool, threshold: float, tolerance: float) -> Iterator[tuple]:
    """Link counts and spanning edges of two blocks of a home."""
    i, j = linked(x, y, same, threshold, tolerance)
    if not len(i):
        return
    sets = np.concatenate([x.sets, y.sets])
    copies = np.concatenate([x.copies, y.copies])
    j = j + len(x.sets)
    count = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
    for k in np.flatnonzero(count).tolist():
        yield (_LINKS, int(sets[k]), None, int(count[k])) + (None,) * 11
    known, ids = np.unique(sets, return_inverse=True)
    a, b = ids[i], ids[j]
    label = np.arange(len(known))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    for k in np.flatnonzero(label != np.arange(len(known))).tolist():
        yield (_EDGE, int(known[label[k]]), int(known[k]), None) + (None,) * 11


def _bucket_rows(x: Block, y: Block, same: bool, band: int, threshold: float, tolerance: float) -> Iterator[tuple]:
    """The likely pairs of two blocks of a bucket that have different homes and agree in no earlier band."""
    allowed = x.homes[:, None] != y.homes
    if same:
        allowed &= np.triu(np.ones(allowed.shape, bool), 1)
    bx, by = x.bands(), y.bands()
    for k in range(band):
        allowed &= bx[:, k][:, None] != by[:, k]
    for i, j in zip(*(z.tolist() for z in likely(x, y, allowed, threshold, tolerance)), strict=True):
        a, b = int(x.sets[i]), int(y.sets[j])
        yield (_PAIR, min(a, b), max(a, b), None) + (None,) * 11


def _compared(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """All pairs of blocks of each group: (kind, a, b, n) rows.

    ``members``: grp, band (null: a home), block, blocks, set_id, copies, home, signature, size, runs.
    """
    def rows_of(x: Block, y: Block, same: bool, band: int | None) -> Iterator[tuple]:
        if band is None:
            return _home_rows(x, y, same, threshold, tolerance)
        return _bucket_rows(x, y, same, band, threshold, tolerance)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, held: dict[int, tuple]) -> Iterator[tuple]:
            grp, block, blocks, band = key
            if blocks == 1 and len(held) < 2:
                return
            sets, copies, homes, signatures, sizes, runs = zip(*held.values(), strict=True)
            row = {"rows": len(sets), "sets": np.array(sets, "<i8").tobytes(), "copies": np.array(copies, "<i8").tobytes(),
                   "homes": np.array(homes, "<i8").tobytes(), "signatures": b"".join(signatures),
                   "sizes": np.array(sizes, "<i4").tobytes(), "runs": None}
            if runs[0] is not None:
                low, high = (b"".join(r[:4 * n] for r, n in zip(runs, sizes, strict=True)),
                             b"".join(r[4 * n:] for r, n in zip(runs, sizes, strict=True)))
                row["runs"] = low + high
            if blocks == 1:
                x = Block(row)
                yield from rows_of(x, x, True, band)
            else:
                yield (_BLOCK, None, None, None, grp, band, block, blocks, *row.values())

        def out() -> Iterator[tuple]:
            now, held = None, {}
            for part in parts:
                for grp, band, block, blocks, *rest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if now != (grp, block, blocks, band):
                        if now:
                            yield from done(now, held)
                        now, held = (grp, block, blocks, band), {}
                    held[rest[0]] = tuple(rest)  # a row that came twice counts once
            if now:
                yield from done(now, held)

        yield from batches(_OUT, out())

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now: tuple, band: int | None, held: list[Block]) -> Iterator[tuple]:
            same = now[1] == now[2]
            if same or len(held) > 1:  # the other block of a pair may be empty
                yield from rows_of(held[0], held[-1], same, band)

        def out() -> Iterator[tuple]:
            now, held, band = None, [], None
            for part in parts:
                for k in range(part.num_rows):
                    row = {n: c[k].as_py() for n, c in zip(part.schema.names, part.columns, strict=True)}
                    if now != (row["grp"], row["i"], row["j"]):
                        if now:
                            yield from done(now, band, held)
                        now, held, band = (row["grp"], row["i"], row["j"]), [], row["band"]
                    held.append(Block(row))
            if now:
                yield from done(now, band, held)

        yield from batches(_OUT, out())

    order = ["grp", "block"]
    columns = ["grp", "band", "block", "blocks", "set_id", "copies", "home", "signature", "size", "runs"]
    first = saved(members.select(*columns).repartition(*order).sortWithinPartitions(*order).mapInArrow(pack, _OUT_DDL), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    items = (first.where(F.col("kind") == _BLOCK).select("*", other)
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
             .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block"))
    more = items.mapInArrow(meet, _OUT_DDL)
    return saved(first.where(F.col("kind") != _BLOCK).unionByName(more).select("kind", "a", "b", "n"), "compared")


def _block(grp: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "set_id", grp), blocks).cast("int")


def _blocks(rows: Column, runs: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(runs / BLOCK_RUNS)).cast("int")


def groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of documents.

    doc_id, _h; class_id (the least doc_id that it is linked to, directly or over others; its own without links) with
    class_h (to tell documents of one id apart); copy_id (the least doc_id with the same runs); n_links (how many other
    rows it is linked to, copies among them).
    """
    found = saved(features(docs), "features")
    full = found.where("set_id is not null")
    classes = saved(full.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "_h")).alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"),
        F.first("signature").alias("signature")).select("set_id", "first.*", "copies", "size", "signature"), "classes")
    band = lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring("signature", k * 4 * ROWS + 1, F.lit(4 * ROWS))).alias("bucket"))
    agreed = classes.select("set_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("x")).select("set_id", "size", "x.*")
    counts = agreed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(attach(agreed, counts.withColumn("members", F.col("n")), ["bucket"], "inner", counts).drop("n"), "members")

    homes = members.groupBy("set_id", "size").agg(F.max(F.struct("members", "bucket")).getField("bucket").alias("home"))
    shares = members.join(homes.select("set_id", "home"), "set_id").groupBy("bucket", "home").agg(F.count("*").alias("n"))
    parents = shares.groupBy("bucket").agg(F.max(F.struct("n", "home")).alias("x"), F.sum("n").alias("all")).select(
        "bucket", F.when(F.col("x.n") * 2 >= F.col("all"), F.col("x.home")).otherwise(F.col("bucket")).alias("parent"))
    parents = saved(parents, "parents")
    for _ in range(2):
        step = parents.select(F.col("bucket").alias("home"), "parent")
        homes = attach(homes, step, ["home"], "left").select("set_id", "size", F.coalesce("parent", "home").alias("home"))
    homes = saved(homes, "homes")

    crowd = homes.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("runs"))
    split = crowd.where("n > 1").select("home", _blocks(F.col("n"), F.col("runs")).alias("blocks"))
    housed = attach(homes, split, ["home"], "inner", crowd.select("home", "n")).withColumn("block", _block(F.col("home"), F.col("blocks")))
    housed = saved(housed.select("set_id", "home", "block", "blocks"), "housed")

    known = classes.select("set_id", "copies", "signature", "size")
    placed = members.select("set_id", "bucket", "band").join(homes.select("set_id", "home"), "set_id")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("home").alias("lo"), F.max("home").alias("hi"))
    split = mixed.where("lo <> hi").select("bucket", _blocks(F.col("n"), F.lit(0)).alias("blocks"))
    apart = (attach(placed, split, ["bucket"], "inner", mixed.select("bucket", "n")).join(known, "set_id")
             .select(F.col("bucket").alias("grp"), "band", _block(F.col("bucket"), F.col("blocks")).alias("block"), "blocks",
                     "set_id", "copies", "home", "signature", "size", F.lit(None).cast("binary").alias("runs")))
    pairs = saved(_compared(apart, threshold, tolerance).where(F.col("kind") == _PAIR).select("a", "b").distinct(), "pairs")

    asked = (housed.select("set_id").union(pairs.select("a")).union(pairs.select("b")).distinct()
             .join(classes, "set_id").join(housed, "set_id", "left"))
    with_runs = saved(_with_runs(docs, asked), "runs")
    at_home = with_runs.where("home is not null").select(
        F.col("home").alias("grp"), F.lit(None).cast("int").alias("band"), "block", "blocks", "set_id", "copies", "home",
        "signature", "size", "runs")
    near = _compared(at_home, threshold, tolerance)
    far = _verified(pairs, with_runs, threshold)

    edges = near.where(F.col("kind") == _EDGE).select("a", "b").unionByName(far.select("a", "b"))
    links = (near.where(F.col("kind") == _LINKS).select(F.col("a").alias("set_id"), "n")
             .unionByName(far.select(F.col("a").alias("set_id"), F.col("b_copies").alias("n")))
             .unionByName(far.select(F.col("b").alias("set_id"), F.col("a_copies").alias("n")))
             .groupBy("set_id").agg(F.sum("n").alias("links")))
    rooted = components(edges).select(F.col("node").alias("set_id"), "root")
    known = classes.select("set_id", "doc_id", "_h", "copies").join(rooted, "set_id", "left").join(links, "set_id", "left")
    known = saved(known.withColumn("root", F.coalesce("root", "set_id")), "rooted")
    heads = known.groupBy("root").agg(F.min(F.struct("doc_id", "_h")).alias("head"))
    answer = attach(known, heads, ["root"], "left").select(
        "set_id", F.col("head.doc_id").alias("class_id"), F.col("head._h").alias("class_h"), F.col("doc_id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = attach(found.select("doc_id", "_h", "set_id"), answer, ["set_id"], "left")
    return rows.select("doc_id", "_h", *(F.when(F.col("set_id").isNull(), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (
        ("class_id", "doc_id"), ("class_h", "_h"), ("copy_id", "doc_id"))), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_runs(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (with doc_id and _h of a document) with the sets of runs."""
    rows = text_rows(docs)
    other = asked.withColumnRenamed("doc_id", "q_doc").withColumnRenamed("_h", "q_h")
    both = rows.join(other, rows["doc_id"].eqNullSafe(other["q_doc"]) & (rows["_h"] == other["q_h"])).drop("doc_id", "_h", "q_doc", "q_h")
    kept = [c for c in both.columns if c != "text"]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            runs = [r.astype("<u4").tobytes() + (r >> np.uint64(32)).astype("<u2").tobytes() for r in _sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(runs, pa.binary())], [*kept, "runs"])

    return both.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in both.dtypes if c != "text") + ", runs binary")


def _verified(pairs: DataFrame, with_runs: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are linked, with the copies of either side."""
    side = lambda s: with_runs.select(F.col("set_id").alias(s), F.col("copies").alias(f"{s}_copies"), F.col("runs").alias(f"{s}_runs"))
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "a_copies", "b_copies")])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(data: bytes) -> np.ndarray:
            n = len(data) // 6
            return np.frombuffer(data[:4 * n], "<u4").astype(np.uint64) | (np.frombuffer(data[4 * n:], "<u2").astype(np.uint64) << np.uint64(32))

        def out() -> Iterator[tuple]:
            for part in parts:
                for a, b, n, x, m, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "a_copies", "a_runs", "b_copies", "b_runs")), strict=True):
                    x, y = runs(x), runs(y)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if reached(np.int64(shared), len(x), len(y), threshold):
                        yield a, b, n, m

        yield from batches(schema, out())

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return saved(both.mapInArrow(work, "a long, b long, a_copies long, b_copies long").distinct(), "verified")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "class_id", "copy_id", "n_links")
