"""Operator 12 against comparing all words, and its trie against every pair."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from lotlens.llm import spelling

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = {i: i + 32 for i in range(65, 91)}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def by_hand(rows, typos=199, least=6, least_count=5, ratio=5):
    n = collections.Counter()
    for i, text in rows:
        for w in _RUN.findall((text or "").translate(_LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % typos == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def found(spark, rows, schema="doc_id long, text string", **more):
    df = spelling.variants(spark.createDataFrame(rows, schema), **more)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def corpus(seed=1, n=300):
    g = random.Random(seed)
    stems = ["".join(g.choice(["ab", "er", "on", "th", "é", "ñ", "in", "s"]) for _ in range(g.randint(3, 6))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = g.choice(stems[: g.choice([4, 20, 60])])
            if g.random() < 0.15:
                k = g.randrange(len(w) + 1)
                w = g.choice([w[:k] + w[k + 1:], w[:k] + g.choice("aeé") + w[k:], w[:k] + g.choice("xnñ") + w[k + 1:]])
            words.append(w.upper() if g.random() < 0.1 else w)
        rows.append((i, g.choice([" ", "\n", ", ", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("typos", [199, 3])
def test_equals_all_pairs(spark, typos):
    rows = corpus()
    got = found(spark, rows, typos=typos)
    assert got == by_hand(rows, typos) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got + [("", "", "x")])


def test_chains_of_forms(spark):
    rows = [(i, " ".join(["abcdef"] * 625 + ["abcdeg"] * 125 + ["abcdhg"] * 25 + ["abcihg"] * 5)) for i in range(3)]
    got = {r[0]: r for r in found(spark, rows, typos=10 ** 9)}
    assert got["abcihg"][1:3] == ("abcdhg", "abcdef") and got["abcdhg"][2] == "abcdef" and got["abcdef"][2] == "abcdef"
    assert sorted(got.values()) == by_hand(rows, 10 ** 9)


def test_ties_go_to_the_smaller_word(spark):
    rows = [(1, " ".join(["zzzzza"] * 5 + ["zzzzzb"] * 25 + ["zzzzzc"] * 25 + ["ézzzza"] * 25))]
    got = {r[0]: r for r in found(spark, rows, typos=10 ** 9)}
    assert got["zzzzza"][1] == "zzzzzb" and sorted(got.values()) == by_hand(rows, 10 ** 9)


def test_awkward_texts(spark):
    long_run, long_text = "abc" * 700, "wordle wordie " * 400_000
    rows = [(None, "nulled nulled nulled nulled nulled nulleds"), (1, None), (2, ""), (3, "1234 .,;"), (4, long_run + " " + long_run[1:]), (4, long_run),
            (5, "ÀÉ×÷ÿà " * 6 + "Ÿbcdefg " * 7), (6, "straße中straßen " * 6), (6, "straße中straßen " * 6),
            (7, long_text), (8, "abcdef"), (9, "abcdefabcdef")] + [(10 + i, long_run) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as near", "4 as part", "5 as size", "6 as form")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())
    assert got == by_hand(rows)


def test_texts_that_meet_without_a_gap(spark):
    rows = [(i, "abcdef") for i in range(20)] + [(50 + i, "ghi") for i in range(20)]
    assert found(spark, rows) == by_hand(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, "short words")]) == []


def test_split_subtrees_and_small_buckets(spark):
    words = sorted({w for _, t in corpus(4, 200) for w in _RUN.findall(t.translate(_LOW)) if len(w) >= 6})
    rows = [(w, 1 + len(w) % 7) for w in words]
    df = spark.createDataFrame(rows, "word string, n long")
    want = {w: [x for x in words if one_edit(w, x)] for w in words}
    n = dict(rows)
    for subtree, bucket in ((3, 1), (1 << 18, 6), (7, 2)):
        got = {r.word: (r.n_near, r.near_n, r.near) for r in spelling.near_words(df, subtree, bucket).collect()}
        assert got == {w: (len(v), max(n[x] for x in v), min(x for x in v if n[x] == max(n[y] for y in v))) for w, v in want.items() if v}


def test_trie_reaches_every_near_word():
    g = np.random.default_rng(2)
    letters = np.unique(g.choice(list(b"entarosh\xe9"), size=(3000, 6)), axis=0).astype(np.uint8)
    trie = spelling.Trie(letters, 0, 2)
    ask = letters[g.choice(len(letters), 50)]
    got = collections.defaultdict(set)
    for q, lo, hi in trie.search(spelling.group_counts(ask), np.ones(50, int), np.ones(50, int), most=97):
        for i, a, b in zip(q.tolist(), lo.tolist(), hi.tolist(), strict=True):
            got[i] |= set(trie.order[a:b].tolist())
    for i in range(50):
        near = set(np.flatnonzero((letters != ask[i]).sum(axis=1) <= 1).tolist())
        assert near <= got[i] and len(got[i]) < len(letters) / 3


def test_checksums():
    buf = np.frombuffer("abcédefghijk".encode() * 20, np.uint8)
    a, b = np.array([0, 3, 5, 0, 7]), np.array([3, 9, 5, 200, 8])
    begun = np.array([zlib.crc32(b"12:")] * 5, np.uint32)
    got = spelling._checksums(buf, a, b, begun)
    assert got.tolist() == [zlib.crc32(b"12:" + buf[x:y].tobytes()) for x, y in zip(a, b, strict=True)]
