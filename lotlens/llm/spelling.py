"""Operator 12: spelling variants by a trie over letter-group counts.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), with A-Z in lower case. Tasks count the words of
at least LEAST_LETTERS code points in their texts before anything is shuffled; words of at least LEAST_COUNT occurrences
stay. Two of them are near if one code point inserted, deleted or replaced makes one of the other.

A word is written as the counts of GROUPS, one after the other; the trie's levels are these counts. One edit raises at
most one count by one and lowers at most one by one, so a depth-first search from a word's own counts spends a surplus
and a deficit of one each. Nodes of at most BUCKET words are leaves, whose words are compared letter by letter. The trie
is cut below its first OUTER levels (and by length) into subtrees, each searched in its own task; a word visits the
subtrees that its budget reaches. A subtree of more than SUBTREE words is dealt into parts by the words' hashes and
visitors go to each of them, so no task holds more than SUBTREE indexed words. Searches go to words of the same length
and of one letter more, which finds each pair of unequal lengths once, and once from either side otherwise.

Matches are reduced to one row for each word in the task: how many, and the commonest. A word's form is its commonest
near word (ties: the smallest by code points) if that occurs at least RATIO times as often; occurrences grow by that
factor along a chain of forms, so roots are found by doubling the steps a few times.

Null and empty texts have no word; a null id counts as an empty one. Repeated rows count each. Words of any length are
handled. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROUND_BYTES, batches, mix, powers, rounds, saved, slices, texts

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: In every ``TYPOS``-th pair of document and word, by checksum, one letter is left out before words are counted.
TYPOS = 199
#: The trie's levels: single letters, the commonest of the Latin scripts first, then the rarer ones and the rest together.
GROUPS = ("e", "n", "a", "i", "t", "r", "o", "s", "h", "l", "u", "d", "c", "m", "g", "b", "p", "f", "w", "y", "v", "k", "qxjz",
          "éèêëÉÈÊË", "óòôöõÓÒÔÖÕ", "áàâäåãÁÀÂÄÅÃ")
OUTER, BUCKET, SUBTREE = 3, 6, 1 << 18
_HELD, _PAIR_BYTES = 1 << 18, 1 << 23

_ASCII = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _checksums(buf: np.ndarray, a: np.ndarray, b: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of buf[a:b] of every word, continued from the checksums ``begun``; the longest words one by one."""
    out = np.empty(len(a), np.uint32)
    n = b - a
    for i in np.flatnonzero(n > 64).tolist():
        out[i] = zlib.crc32(buf[a[i]:b[i]].tobytes(), int(begun[i]))
    order = np.flatnonzero(n <= 64)
    order = order[np.argsort(-n[order], kind="stable")]
    start, state = a[order], begun[order] ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-n[order], -np.arange(1, 65), "right")  # how many words have a byte at each place
    for k, m in enumerate(longer.tolist()):
        if not m:
            break
        some = state[:m]
        state[:m] = _CRC[(some ^ buf[start[:m] + k]) & np.uint32(255)] ^ (some >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _found(buf: np.ndarray, off: np.ndarray, prefixes: list[bytes], typos: int, least: int) -> Iterator[tuple]:
    """Words of some texts, as ``_distinct`` gives them, of at least ``least`` code points."""
    lead = buf == 0xC3  # the two bytes of U+00C0 to U+00FF are C3 and a continuation
    inside = np.zeros(len(buf) + 2, np.int8)
    letter = _ASCII[buf] | lead
    letter[1:] |= lead[:-1]
    inside[1:-1] = letter
    ends = off[1:-1]
    ends = ends[(ends > 0) & (ends < len(buf))]
    a, b = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    # A run that crosses the end of a text is two.
    cut = np.unique(ends[letter[ends] & letter[ends - 1]]) if len(ends) else ends
    a, b = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
    wide = np.concatenate([[0], np.cumsum(lead)])
    letters = b - a - (wide[b] - wide[a])
    fine = letters >= least
    a, b, letters = a[fine], b[fine], letters[fine]
    if not len(a):
        return
    buf = _LOWER[buf]
    row = np.searchsorted(off, a, "right") - 1
    begun = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    h = _checksums(buf, a, b, begun[row])
    typed = h % np.uint32(typos) == 0
    if typed.any():
        at = np.flatnonzero(typed)
        lost = h[at] % letters[at].astype(np.uint32)
        made = [w[:k] + w[k + 1:] for w, k in zip((buf[x:y].tobytes().decode() for x, y in zip(a[at], b[at], strict=True)),
                                                  lost.tolist(), strict=True)]
        made = [w.encode() for w in made if len(w) >= least]
        if made:
            ends = np.cumsum([0, *map(len, made)])
            yield _distinct(np.frombuffer(b"".join(made), np.uint8), ends[:-1], ends[1:], None)
    yield _distinct(buf, a[~typed], b[~typed], None)


def _hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = b - a
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(size.sum()) - np.repeat(first, size)
    body = buf[place + np.repeat(a, size)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(body * powers(int(size.max()))[place], first) + size.astype(np.uint64))


def _distinct(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None, h: np.ndarray | None = None) -> tuple:
    """Bytes, offsets, summed occurrences and hashes of the distinct words among buf[a:b], told apart by 64-bit hashes."""
    if not len(a):
        return buf[:0], np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if h is None:
        h = _hashes(buf, a, b)
    h, one, back = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(back, n, len(one)).astype(np.int64)
    a, size = a[one], (b - a)[one]
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(off[-1], np.uint8)
    for lo, hi in rounds(off):
        place = np.arange(off[hi] - off[lo]) + np.repeat(a[lo:hi] - off[lo:hi] + off[lo], size[lo:hi])
        out[off[lo]:off[hi]] = buf[place]
    return out, off, total, h


def _pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of about a round's bytes: first and end row, bytes, offsets; a very long text by parts that end between words."""
    for lo, hi in rounds(off):
        if off[hi] - off[lo] <= 4 * ROUND_BYTES:
            yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            continue
        at, end = int(off[lo]), int(off[hi])
        while at < end:
            to = min(end, at + ROUND_BYTES)
            gap = np.flatnonzero(~_ASCII[buf[at:to]] & (buf[at:to] < 128)) if to < end else None
            if gap is not None and len(gap):
                to = at + int(gap[-1]) + 1
            elif gap is not None:
                more = np.flatnonzero(~_ASCII[buf[to:end]] & (buf[to:end] < 128))
                to = to + int(more[0]) + 1 if len(more) else end
            yield lo, hi, buf[at:to], np.array([0, to - at])
            at = to


def counted(docs: DataFrame, typos: int = TYPOS, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: every distinct word that is long and frequent enough."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            buf = np.concatenate([h[0] for h in held])
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            a = np.concatenate([h[1][:-1] + s for h, s in zip(held, base, strict=False)])
            b = np.concatenate([h[1][1:] + s for h, s in zip(held, base, strict=False)])
            return _distinct(buf, a, b, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))

        def out() -> Iterator[pa.RecordBatch]:
            buf, off, n, _ = merged()
            held.clear()
            for lo, hi in rounds(off, 1 << 22):
                part = (off[lo:hi + 1] - off[lo]).astype(np.int32)
                words = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(part), pa.py_buffer(buf[off[lo]:off[hi]]))
                yield pa.RecordBatch.from_arrays([words, pa.array(n[lo:hi])], schema=_COUNTS)

        some = kept = 0
        for part in slices(parts):
            prefixes = [f"{'' if i is None else i}:".encode() for i in part.column(0).to_pylist()]
            for lo, hi, buf, off in _pieces(*texts(part.column(1))):
                for found in _found(buf, off, prefixes[lo:hi], typos, least):
                    held.append(found)
                    some += len(found[2])
                if some > kept + _HELD:
                    held[:] = [merged()]
                    some = kept = len(held[0][2])
                    if kept > 2 * _HELD:
                        yield from out()
                        some = kept = 0
        if held:
            yield from out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _count_of(group: str, word: str) -> Column:
    return F.length(word) - F.length(F.translate(F.col(word), group, ""))


class Trie:
    """Words of one length (rows of ``letters``, Latin-1) under the counts of GROUPS, from level ``begin`` on."""

    def __init__(self, letters: np.ndarray, begin: int, bucket: int = BUCKET):
        counts = group_counts(letters)
        order = np.lexsort(counts.T[::-1])
        self.order, self.letters = order, letters[order]
        counts = counts[order]
        self.begin, self.stride = begin, int(counts.max(initial=0)) + 3
        self.levels = []
        # A level: its nodes' keys (parent's number and count), first and end word, and number on the next level (-1: a leaf).
        first, end = np.array([0]), np.array([len(order)])
        live = len(order) > bucket
        self.root = 0 if live else -1
        for g in range(begin, len(GROUPS) if live else 0):
            rows = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange((end - first).sum())
            parent = np.repeat(np.arange(len(first)), end - first)
            key = parent * self.stride + counts[rows, g] + 1
            edge = np.flatnonzero(np.diff(key, prepend=-1))
            lo, hi = rows[edge], rows[np.append(edge[1:], len(rows)) - 1] + 1
            grow = (hi - lo > bucket) & (g + 1 < len(GROUPS))
            below = np.where(grow, np.cumsum(grow) - 1, -1)
            self.levels.append((key[edge], lo, hi, below))
            first, end = lo[grow], hi[grow]
            if not len(first):
                break

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, first and end candidate) for leaves that the words' budgets reach; deep first, in blocks."""
        n = len(counts)
        if self.root < 0:
            yield np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.order))
            return
        stack = [(0, np.arange(n), np.zeros(n, np.int64), surplus, deficit)]
        while stack:
            level, q, node, s, d = stack.pop()
            if len(q) > most:
                half = len(q) // 2
                stack += [(level, q[half:], node[half:], s[half:], d[half:]), (level, q[:half], node[:half], s[:half], d[:half])]
                continue
            keys, lo, hi, below = self.levels[level]
            want = node * self.stride + np.minimum(counts[q, self.begin + level], self.stride - 2) + 1
            q, want = np.concatenate([q, q[s > 0], q[d > 0]]), np.concatenate([want, want[s > 0] + 1, want[d > 0] - 1])
            s, d = np.concatenate([s, s[s > 0] - 1, s[d > 0]]), np.concatenate([d, d[s > 0], d[d > 0] - 1])
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            q, at, s, d = q[hit], at[hit], s[hit], d[hit]
            leaf = below[at] < 0
            if leaf.any():
                yield q[leaf], lo[at[leaf]], hi[at[leaf]]
            if not leaf.all():
                stack.append((level + 1, q[~leaf], below[at[~leaf]], s[~leaf], d[~leaf]))


_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _k, _g in enumerate(GROUPS):
    _GROUP_OF[list(_g.encode("latin-1"))] = _k


def group_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of GROUPS in words of one length; letters of no group are not counted."""
    width = len(GROUPS) + 1
    out = np.zeros((len(letters), width), np.int32)
    for lo in range(0, letters.shape[1], 1024):
        some = _GROUP_OF[letters[:, lo:lo + 1024]] + np.arange(len(letters))[:, None] * width
        out += np.bincount(some.ravel(), minlength=out.size).reshape(out.shape).astype(np.int32)
    return out[:, :-1]


def _one_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x become those of y (as long, or one longer) by exactly one edit."""
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    head, tail = x == y[:, :n], x == y[:, 1:]
    same = np.where(head.all(axis=1), n, head.argmin(axis=1))
    rest = np.where(tail.all(axis=1), n, tail[:, ::-1].argmin(axis=1))
    return same + rest >= n


def _matches(trie: Trie, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked row, indexed row) that are one edit apart."""
    most = max(1, _PAIR_BYTES // trie.letters.shape[1])
    for q, lo, hi in trie.search(group_counts(asked), surplus, deficit):
        n = hi - lo
        ends = np.cumsum(n)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + most, "right")))
            for start in range(0, int(n[at]) if to == at + 1 else 1, most):  # a leaf of equal counts may be large
                some = n[at:to] if to > at + 1 else np.minimum(n[at:to] - start, most)
                x = np.repeat(q[at:to], some)
                y = np.repeat(lo[at:to] + start - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
                fit = _one_apart(asked[x], trie.letters[y])
                if fit.any():
                    yield x[fit], trie.order[y[fit]]
            at = to


class _Best:
    """For each word of a list: how many near words, the commonest of them and its occurrences."""

    def __init__(self, words: list[bytes]):
        self.words = words
        order = np.argsort(np.array(words))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.n = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, bytes]] = {}

    def add(self, at: np.ndarray, n: np.ndarray, who: np.ndarray, others: _Best) -> None:
        self.n += np.bincount(at, minlength=len(self.n))
        order = np.lexsort((others.rank[who], -n, at))
        first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        for i, m, w in zip(at[first].tolist(), n[first].tolist(), who[first].tolist(), strict=True):
            new, old = (-m, others.words[w]), self.best.get(i)
            if old is None or new < old:
                self.best[i] = new

    def rows(self) -> Iterator[tuple]:
        for i, (m, w) in self.best.items():
            yield self.words[i].decode("latin-1"), int(self.n[i]), -m, w.decode("latin-1")


def near_words(words: DataFrame, subtree: int = SUBTREE, bucket: int = BUCKET) -> DataFrame:
    """word, n_near, near and near_n (the commonest near word) for the words (word, n) that have near ones."""
    outer = [f"c{k}" for k in range(OUTER)]
    rows = words.select("word", "n", F.length("word").alias("size"),
                        *(_count_of(g, "word").alias(c) for g, c in zip(GROUPS, outer, strict=False)))
    rows = saved(rows, "words")
    home = ["size", *outer]
    # One row for each length and outer counts in use, with the parts that its words are dealt into.
    homes = rows.groupBy(*home).agg(F.ceil(F.count("*") / subtree).cast("int").alias("parts"))
    indexed = (rows.join(homes, home)
               .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
               .select(*home, "part", F.lit(0).alias("kind"), "word", "n", F.lit(0).alias("surplus"), F.lit(0).alias("deficit")))
    zero = [0] * OUTER

    def moved(up: int | None, down: int | None) -> list[int]:
        return [(k == up) - (k == down) for k in range(OUTER)]

    # Steps to a subtree that the budget reaches: change of length and outer counts, surplus and deficit left.
    steps = [(0, zero, 1, 1)]
    steps += [(0, moved(i, None), 0, 1) for i in range(OUTER)] + [(0, moved(None, i), 1, 0) for i in range(OUTER)]
    steps += [(0, moved(i, j), 0, 0) for i in range(OUTER) for j in range(OUTER) if i != j]
    steps += [(1, zero, 1, 0)] + [(1, moved(i, None), 0, 0) for i in range(OUTER)]
    reach = F.explode(F.array(*(F.struct((F.col("size") + by).alias("size"), *((F.col(c) + m).alias(c) for c, m in zip(outer, change, strict=True)),
                                         F.lit(s).alias("surplus"), F.lit(d).alias("deficit")) for by, change, s, d in steps)))
    asked = (rows.select("word", "n", reach.alias("to")).select("word", "n", "to.*").join(homes, home)
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*home, "part", F.lit(1).alias("kind"), "word", "n", "surplus", "deficit"))
    place = [*home, "part"]
    met = indexed.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind", F.length("word"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, gathered, trie, own = None, [], None, None

            def lists(some: list[pa.RecordBatch]) -> list:
                table = pa.Table.from_batches(some)
                return [[w.encode("latin-1") for w in table.column("word").to_pylist()],
                        *(np.asarray(table.column(c)) for c in ("n", "surplus", "deficit"))]

            for part in parts:
                keys = np.stack([np.asarray(part.column(c)) for c in place])
                kind = np.asarray(part.column("kind"))
                change = np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(kind) != 0)) + 1
                for lo, hi in zip([0, *change.tolist()], [*change.tolist(), part.num_rows], strict=True):
                    at = tuple(keys[:, lo].tolist())
                    if at != now:
                        if own:
                            yield from own.rows()
                        now, gathered, trie, own = at, [], None, None
                    if kind[lo] == 0:
                        gathered.append(part.slice(lo, hi - lo))
                        continue
                    if trie is None:
                        if not gathered:
                            continue
                        words, n, _, _ = lists(gathered)
                        gathered = []
                        trie = Trie(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1), OUTER, bucket)
                        own = _Best(words)
                    yield from met_here(trie, own, n, *lists([part.slice(lo, hi - lo)]))
            if own:
                yield from own.rows()

        def met_here(trie: Trie, own: _Best, own_n: np.ndarray, words: list[bytes], n: np.ndarray, surplus: np.ndarray,
                     deficit: np.ndarray) -> Iterator[tuple]:
            size = np.array([len(w) for w in words])
            for length in np.unique(size).tolist():
                pick = np.flatnonzero(size == length)
                some = [words[i] for i in pick.tolist()]
                letters = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)
                best = _Best(some)
                for x, y in _matches(trie, letters, surplus[pick], deficit[pick]):
                    best.add(x, own_n[y], y, own)
                    if length < trie.letters.shape[1]:
                        own.add(y, n[pick][x], x, best)
                yield from best.rows()

        yield from batches(_NEAR, out())

    found = met.mapInArrow(work, "word string, n_near long, near_n long, near string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("near_n").alias("near_n"),
                                      F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("near")))


def variants(docs: DataFrame, typos: int = TYPOS, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents that is long and frequent enough."""
    words = saved(counted(docs, typos, least, least_count), "counts")
    near = near_words(words)
    form = F.col("near_n") >= ratio * F.col("n")
    found = saved(words.join(near, "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                          F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "forms")
    # Occurrences grow by ``ratio`` with every step, so a chain has at most this many.
    most = words.agg(F.max("n")).first()[0] or 1
    chain = 1 + int(math.log(max(1, most / least_count), ratio))
    steps = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = saved(steps.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "steps")
    return (found.join(steps, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
