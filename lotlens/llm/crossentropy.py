"""Operator 7: language-model scores by cross-entropy difference.

Two word bigram models of one form are counted on two matched corpora: the target (documents labelled as good) and the
background (all documents). They share one vocabulary, the words seen at least MIN_COUNT times in all documents; every
other word is one unknown word. A model mixes its bigram and unigram shares, both smoothed by one:

    p(w | v) = MIX * (c(v, w) + 1) / (c(v) + BIGRAMS / VOCABULARY + 1) + (1 - MIX) * (c(w) + 1) / (N + VOCABULARY)

VOCABULARY and BIGRAMS only smooth; where more words than VOCABULARY are known, their number stands in N + VOCABULARY.
Each document's first word follows a mark. Its score is the mean over its words of the background's loss less the
target's, in nats: above 0 the document is more like the target. Background counts are scaled down to the target's
number of words, so the models are smoothed alike.

Words and bigrams are known by full 64-bit hashes and counted one by one, whatever their number: words are added up in
tasks, then in a shuffle, and written as a table. Each document gets the counts of its words by a join. Its bigrams go
to buckets of hashes, where all rows of a bigram meet: they are counted there, and their losses go back to the documents'
round of texts, packed, one row for each bucket and round.
Words with 1 / HOT of all words and bigrams with 1 / HOT_PAIRS of them, of which there are no more than HOT and
HOT_PAIRS, are broadcast with their counts instead, so no key brings many rows to a task. Bigrams of two broadcast words
are sent as the places of these in the table, which say both the bigram and the counts; the rest as hashes with counts.

Words are letters, digits and non-ASCII characters in lower case. Null and empty texts score 0 with no word. Rows of
``labels`` with a null take no part; a document is in the target if any label says so. Without a target every score is
that of an empty target model.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, batches, mix, rounds, saved, text_rows, texts, words

VOCABULARY, BIGRAMS, MIN_COUNT, MIX = 1 << 18, 1 << 21, 2, 0.6
HOT, HOT_PAIRS = 1 << 20, 1 << 14
#: Words whose bigrams one bucket takes, about; bytes of text whose bigrams are sent together; counts a task holds.
BUCKET, ROUND, HELD = 1 << 21, 1 << 22, 1 << 20
_UNKNOWN, _MARK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("h", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
_PARCELS = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("home", pa.int64())])
_RETURNS = pa.schema([("home", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
_SUMS = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("l0", pa.float64()), ("l1", pa.float64())])


def _rounds(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, word hashes and row offsets of each round of texts."""
    buf, off = texts(pc.utf8_lower(column))
    for lo, hi in rounds(off, ROUND):
        h, _, _, w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], PLAIN)
        yield lo, hi, h, w


def _flags(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(bool)


def _edges(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _summed(h: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(h):
        return h, n0, n1
    order = np.argsort(h)
    h = h[order]
    at = _edges(h)
    return h[at], np.add.reduceat(n0[order], at), np.add.reduceat(n1[order], at)


def _tallied(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts by hash, added up as far as a task may hold them."""
    held, size = [], 0

    def out(h: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(h), 50_000):
            some = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n0[some]), pa.array(n1[some])], schema=_COUNTS)

    for h, n0, n1 in found:
        held.append(_summed(h, n0.astype(np.int64), n1.astype(np.int64)))
        size += len(held[-1][0])
        if size > HELD:
            one = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [one], len(one[0])
            if size > HELD // 2:
                yield from out(*one)
                held, size = [], 0
    if held:
        yield from out(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _counted(rows: DataFrame, work) -> DataFrame:
    return rows.mapInArrow(work, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _word_counts(marked: DataFrame) -> DataFrame:
    """Counts of each word in the target (n0) and in all documents (n1); at the mark, documents that have words."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part in parts:
                good = _flags(part.column(1))
                for lo, hi, h, w in _rounds(part.column(0)):
                    n = np.diff(w)
                    yield h, np.repeat(good[lo:hi], n), np.ones(len(h))
                    yield np.array([_MARK]), np.array([(good[lo:hi] & (n > 0)).sum()]), np.array([(n > 0).sum()])

        yield from _tallied(found())

    return _counted(marked.select("text", "target"), count)


def _sorted(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their two counts, collected as columns."""
    rows = counts.select("h", "n0", "n1").toArrow()
    h, n0, n1 = (np.asarray(c.to_numpy()) for c in rows.columns)
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], np.stack([n0, n1], 1).astype(np.int64)[order]


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in sorted keys, and which are there."""
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)


def _rare(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """The words of each row that are not broadcast: row, h."""
    out = pa.schema([("row", pa.int64()), ("h", pa.int64())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, h, w in _rounds(part.column(1)):
                u, back = np.unique(h, return_inverse=True)
                cold = np.flatnonzero(~_found(hot, u)[1][back])
                row = np.repeat(np.arange(lo, hi), np.diff(w))[cold]
                order = np.lexsort((h[cold], row))
                row, some = row[order], h[cold][order]
                at = _edges(row, some)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[at]], pa.int64()), pa.array(some[at].view(np.int64))], schema=out)

    return docs.select("_h", "text").mapInArrow(work, "row long, h long")


class Words:
    """Counts of words: those of broadcast words, of the unknown word and of the mark; each document brings its others."""

    def __init__(self, hot: tuple[np.ndarray, np.ndarray], unknown: tuple[int, int], mark: tuple[int, int], n: tuple[int, int], known: int):
        self.hot, self.unknown, self.mark, self.n = hot, np.array(unknown, np.int64), np.array(mark, np.int64), n
        self.min_count, self.ratio, self.size, self.share = MIN_COUNT, BIGRAMS / VOCABULARY, max(VOCABULARY, known), MIX
        # Places: 0 the unknown word, 1 the mark, then the broadcast words from the commonest on.
        order = np.lexsort((hot[0], -hot[1][:, 1]))
        order = order[hot[1][order, 1] >= MIN_COUNT]
        self.place = np.zeros(len(hot[0]), np.int32)
        self.place[order] = np.arange(2, len(order) + 2)
        self.placed = np.concatenate([[self.unknown, self.mark], hot[1][order]])
        self.scale = (1.0, n[0] / n[1] if n[0] and n[1] else 1.0)

    def bigrams(self, h: np.ndarray, w: np.ndarray, rare: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A round's bigrams: hashes, counts of their words (before 0, before 1, word 0, word 1) and names by two places, else -1."""
        u, back = np.unique(h, return_inverse=True)
        count, have, place = np.zeros((len(u), 2), np.int64), np.zeros(len(u), bool), np.full(len(u), -1, np.int64)
        for (keys, counts), places in ((self.hot, self.place), (rare, None)):
            at, there = _found(keys, u)
            count[there] = counts[at[there]]
            if places is not None:
                place[there] = places[at[there]]
            have |= there
        if not have.all():
            raise ValueError("a word without a count")
        seen = count[:, 1] >= self.min_count
        u, count, place = np.where(seen, u, _UNKNOWN), np.where(seen[:, None], count, self.unknown), np.where(seen, place, 0)
        word, last, to = u[back], count[back], place[back]
        before, first, at = np.empty_like(word), np.empty_like(last), np.empty_like(to)
        before[1:], first[1:], at[1:] = word[:-1], last[:-1], to[:-1]
        begin = w[:-1][np.diff(w) > 0]
        before[begin], first[begin], at[begin] = _MARK, self.mark, 1
        name = np.where((at >= 0) & (to >= 0), at * len(self.placed) + to, -1)
        return mix((before + _ODD) * _ODD + mix(word)), np.concatenate([first, last], 1), name

    def counts(self, names: np.ndarray) -> np.ndarray:
        """The counts of the words of bigrams named by two places."""
        at, to = np.divmod(names.astype(np.int64), len(self.placed))
        return np.concatenate([self.placed[at], self.placed[to]], 1)

    def losses(self, pairs: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Losses of bigrams in both models from their own counts (n, 2) and those of their words."""
        out = []
        for m, s in enumerate(self.scale):
            bigram = (s * pairs[:, m] + 1) / (s * counts[:, m] + self.ratio + 1)
            unigram = (s * counts[:, 2 + m] + 1) / (s * self.n[m] + self.size)
            out.append(-np.log(self.share * np.minimum(bigram, 1.0) + (1 - self.share) * unigram))
        return out


def _told(part: pa.RecordBatch) -> Iterator[tuple]:
    """Row keys, target flags, hashes, offsets and the counts of rare words of each round of (_h, target, text, rare)."""
    key, good, rare = part.column(0).to_numpy(zero_copy_only=False), _flags(part.column(1)), part.column(3)
    for lo, hi, h, w in _rounds(part.column(2)):
        some = rare.slice(lo, hi - lo).flatten()
        k, n0, n1 = (np.asarray(x.to_numpy(zero_copy_only=False)).astype(np.int64) for x in some.flatten())
        k, at = np.unique(k.view(np.uint64), return_index=True)
        yield key[lo:hi], good[lo:hi], h, w, (k, np.stack([n0[at], n1[at]], 1))


def _common_pairs(told: DataFrame, model: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams with 1 / HOT_PAIRS of all words and their counts. Both words of such a one are that common."""
    most, total = HOT_PAIRS, model.n[1]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part in parts:
                for _, good, h, w, rare in _told(part):
                    pair, counts, _ = model.bigrams(h, w, rare)
                    often = np.minimum(counts[:, 1], counts[:, 3]) >= total / most
                    yield pair[often], np.repeat(good, np.diff(w))[often], np.ones(int(often.sum()))

        yield from _tallied(found())

    return _sorted(_counted(told, work).where(F.col("n1") >= total / most))


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, which pack better than numbers one by one."""
    flat = np.ascontiguousarray(x).reshape(-1)
    return flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def _parcel(bucket: int, head: tuple[int, int, int], *arrays: np.ndarray) -> tuple:
    data = b"".join([np.array(head, "<i8").tobytes(), *map(_planes, arrays)])
    return bucket, len(data), pa.compress(data, codec="zstd", asbytes=True)


def _sent(told: DataFrame, model: Words, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Parcels of bigrams for each bucket, and of the losses that are known already."""
    def parcels(left: np.ndarray, pair: np.ndarray, counts: np.ndarray, name: np.ndarray, doc: np.ndarray, good: np.ndarray) -> Iterator[tuple]:
        """Of the bigrams at ``left``, which all have a name or all have none."""
        if not len(left):
            return
        named = bool(name[left[0]] >= 0)
        known = name[left].astype(np.uint64) if named else pair[left]
        order = np.argsort(known, kind="stable")
        left, known = left[order], known[order]
        bucket = ((pair[left] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if named:  # hashes are in the order of their buckets
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            left, known, bucket = left[order], known[order], bucket[order]
        d = doc[left]
        entry = _edges(known, d)
        times = np.diff(np.append(entry, len(known)))
        ep, ed = known[entry], d[entry]
        first = _edges(ep)
        up, uc, ub = ep[first], counts[left[entry[first]]], bucket[entry[first]]
        stop = np.append(first, len(ep))
        for a, b in pairwise([*_edges(ub).tolist(), len(up)]):
            x, y = stop[a], stop[b]
            docs, place = np.unique(ed[x:y], return_inverse=True)
            # Hashes and names are in order: the gaps between them are smaller numbers.
            yield _parcel(int(ub[a]), (b - a, (x - y) if named else (y - x), len(docs)), np.diff(up[a:b], prepend=np.uint64(0)),
                          *([] if named else [uc[a:b].T.astype("<i8")]), np.diff(stop[a:b + 1]).astype("<i4"), place.astype("<i4"),
                          times[x:y].astype("<i4"), np.diff(docs, prepend=0).astype("<i8"), good[docs].astype("i1"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for key, good, h, w, rare in _told(part):
                pair, counts, name = model.bigrams(h, w, rare)
                n = np.diff(w)
                doc = np.repeat(np.arange(len(n)), n)
                at, often = _found(hot[0], pair)
                done = model.losses(hot[1][at[often]], counts[often])
                sums = [np.bincount(doc[often], x, len(n)) for x in done]
                rows = [_parcel(int(np.uint64(key[0].astype(np.uint64)) % np.uint64(buckets)), (-1, 0, len(n)), key.astype("<i8"), n.astype("<i8"), *sums)]
                for some in (name < 0, name >= 0):
                    rows += parcels(np.flatnonzero(~often & some), pair, counts, name, doc, good)
                home = xxhash.xxh3_64_intdigest(key.tobytes()) - (1 << 63)  # rounds that share it have the same rows
                rows = [(*row, home) for row in rows]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in
                                                      zip(zip(*rows[lo:lo + 256], strict=True), _PARCELS, strict=True)], schema=_PARCELS)

    return told.mapInArrow(work, "bucket int, size long, data binary, home long")


def _opened(size: int, data: bytes) -> tuple[tuple[int, int, int], list[np.ndarray]]:
    """Numbers of bigrams (-1: known losses, -2: losses going back), entries (below 0: of named bigrams, which bring no
    counts) and rows; the arrays. Rows are gaps between places in their round, but keys where losses are known."""
    raw = pa.decompress(data, size, codec="zstd", asbytes=True)
    pairs, entries, docs = head = tuple(np.frombuffer(raw, "<i8", 3).tolist())
    kinds = ([("<i8", docs), *([("<i8", docs)] if pairs == -1 else []), ("<f8", docs), ("<f8", docs)] if pairs < 0 else
             [("<u8", pairs), *([("<i8", 4 * pairs)] if entries >= 0 else []), ("<i4", pairs), ("<i4", abs(entries)), ("<i4", abs(entries)),
              ("<i8", docs), ("i1", docs)])
    out, at = [], 24
    for kind, n in kinds:
        out.append(_numbers(raw, kind, n, at))
        at += out[-1].nbytes
    if pairs >= 0:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return head, out


def _lost(parcels: DataFrame, model: Words) -> DataFrame:
    """Losses by row and round, in parts: every bigram counted over its whole bucket."""
    def done(held: dict[int, list[list[np.ndarray]]], named: bool, lost: dict[int, list[tuple]]) -> None:
        """Adds places of rows and their two losses to ``lost``, by round."""
        if not held:
            return
        every, first, back = np.unique(np.concatenate([x[0] for one in held.values() for x in one]), return_index=True, return_inverse=True)
        counts = model.counts(every) if named else np.concatenate([x[1].reshape(4, -1).T for one in held.values() for x in one])[first]
        total, at = np.zeros((len(every), 2)), 0
        for pairs, *_, reps, docs, times, _, good in (x for one in held.values() for x in one):
            mine = np.repeat(back[at:at + len(pairs)], reps)
            total[:, 0] += np.bincount(mine, times * good[docs], len(every))
            total[:, 1] += np.bincount(mine, times, len(every))
            at += len(pairs)
        each, at = model.losses(total, counts), 0
        for home, pairs, *_, reps, docs, times, rows, _ in ((home, *x) for home, one in held.items() for x in one):
            mine = np.repeat(back[at:at + len(pairs)], reps)
            lost.setdefault(home, []).append((np.cumsum(rows), *(np.bincount(docs, x[mine] * times, len(rows)) for x in each)))
            at += len(pairs)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(held: dict, names: dict) -> Iterator[tuple]:
            lost: dict[int, list[tuple]] = {}
            done(held, False, lost)
            done(names, True, lost)
            for home, some in lost.items():
                place, l0, l1 = (np.concatenate(x) for x in zip(*some, strict=True))
                rows, back = np.unique(place, return_inverse=True)
                sums = [np.bincount(back, x, len(rows)) for x in (l0, l1)]
                yield home, *_parcel(0, (-2, 0, len(rows)), np.diff(rows, prepend=0).astype("<i8"), *sums)[1:]

        def out() -> Iterator[tuple]:
            now, held, names = None, {}, {}
            for part in parts:
                for bucket, size, data, home in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bucket != now:
                        yield from ended(held, names)
                        now, held, names = bucket, {}, {}
                    head, arrays = _opened(size, data)
                    if head[0] < 0:
                        yield home, size, data
                    else:
                        (held if head[1] >= 0 else names).setdefault(home, []).append(arrays)
            yield from ended(held, names)

        yield from batches(_RETURNS, out(), most=256)

    return parcels.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "home long, size long, data binary")


def _added(returns: DataFrame) -> DataFrame:
    """Words (n) and losses of the rows of each round, whose parts meet in one task."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(known: list, some: list) -> Iterator[pa.RecordBatch]:
            if not known:
                return
            keys = known[0][0]
            n, *sums = (np.sum(x, 0) for x in list(zip(*known, strict=True))[1:])
            for gaps, *lost in some:
                rows = np.cumsum(gaps)
                for total, x in zip(sums, lost, strict=True):
                    total[rows] += x
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, n, *sums), _SUMS, strict=True)], schema=_SUMS)

        now, known, some = None, [], []
        for part in parts:
            for home, size, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if home != now:
                    yield from done(known, some)
                    now, known, some = home, [], []
                head, arrays = _opened(size, data)
                (known if head[0] == -1 else some).append(arrays)
        yield from done(known, some)

    return returns.repartition("home").sortWithinPartitions("home").mapInArrow(work, "h long, n long, l0 double, l1 double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (means in nats) and score of every document."""
    good = (labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").cast("long").alias("g_doc")).distinct())
    rows = text_rows(docs).select("doc_id", "text", "_h")
    # Labels cover a share of the documents, so both are shuffled at any size: one plan, whose cost follows the input.
    marked = saved(rows.join(good.hint("merge"), F.col("doc_id") == F.col("g_doc"), "left").select(
        "doc_id", "_h", "text", F.col("g_doc").isNotNull().alias("target")), "marked")

    every = saved(_word_counts(marked), "words")
    real, known = every.where(F.col("h") != int(_MARK.view(np.int64))), F.col("n1") >= MIN_COUNT
    sums = real.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n0", "n1")), *(F.coalesce(F.sum(F.when(~known, F.col(x))), F.lit(0)) for x in ("n0", "n1")),
                    F.count(F.when(known, 1))).first()
    mark = every.where(F.col("h") == int(_MARK.view(np.int64))).first() or (0, 0, 0)
    n, often = tuple(sums[:2]), F.col("n1") * HOT >= int(sums[1])
    model = Words(_sorted(real.where(often)), tuple(sums[2:4]), tuple(mark[1:]), n, sums[4] + 1)

    rare = _rare(marked, model.hot[0]).join(real.where(~often).hint("merge"), "h").groupBy("row").agg(F.collect_set(F.struct("h", "n0", "n1")).alias("rare"))
    told = saved(marked.join(rare.hint("merge"), F.col("_h") == F.col("row"), "left").select(
        "doc_id", "_h", "target", "text", F.coalesce("rare", F.array().cast("array<struct<h:bigint,n0:bigint,n1:bigint>>")).alias("rare")), "told")
    part = told.select("_h", "target", "text", "rare")
    parcels = _sent(part, model, _common_pairs(part, model), max(1, -(-n[1] // BUCKET)))
    # Rows that agree in id and text share a key: their words and losses are added up alike, so the means are theirs.
    lost = _added(_lost(parcels, model)).groupBy("h").agg(F.max("n").alias("n_words"), F.sum("n").alias("n"), F.sum("l0").alias("l0"), F.sum("l1").alias("l1"))
    mean = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(0.0)
    return told.select("doc_id", "_h").join(lost.hint("merge"), F.col("_h") == F.col("h"), "left").select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), mean("l0").alias("loss_target"), mean("l1").alias("loss_background")
    ).withColumn("score", F.col("loss_background") - F.col("loss_target"))
