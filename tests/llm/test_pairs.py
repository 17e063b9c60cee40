"""Operators 6, 9 and 10 and the pipeline against brute force."""

import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from lotlens.llm import bitmap, components, decontamination, fmindex, ngram_join, queries, stages, substrings
from lotlens.llm.common import WHITE, PLAIN, texts, words

ODD = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "x " * 5000), (6, "ñ 日本 \U0001f600")]


def prose(r, n):
    return " ".join(r.choice(("the", "of", "and")) if r.random() < 0.3 else f"w{r.randint(0, 4000)}" for _ in range(n))


def test_words_of_many_rows():
    import pyarrow as pa
    rows = ["ab cd", "ef", "", None, "gh  ij ", "  ", "ab\x0bcd\x1cx", "ñandú, -日本"]
    buf, off = texts(pa.array(rows)[1:])
    h, a, b, w = words(buf, off, WHITE)
    got = [buf[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)]
    want = [(r or "").encode().split() for r in rows[1:]]
    assert got == [x.decode() for r in want for x in r] and np.diff(w).tolist() == [len(r) for r in want]
    h, a, b, w = words(*texts(pa.array(["Ab-cd ab é"])), PLAIN)
    assert len(h) == 4 and len(set(h.tolist())) == 4


def test_a_very_long_row_has_the_words_of_its_parts(monkeypatch):
    import pyarrow as pa
    from lotlens.llm import common
    text = "".join(random.Random(1).choice(["ab", " ", "cde", "\n"]) for _ in range(5000))
    whole = words(*texts(pa.array([text])), WHITE)
    monkeypatch.setattr(common, "ROUND_BYTES", 64)
    parts = words(*texts(pa.array([text])), WHITE)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_bitmap_never_says_no_by_mistake(spark):
    r = np.random.default_rng(1)
    inside, outside = (r.integers(-1 << 63, 1 << 63, 2000, dtype=np.int64) for _ in range(2))
    bits = bitmap.gathered(spark.createDataFrame([(int(x),) for x in inside], "h long").repartition(3), 16)
    assert bitmap.holds(bits, inside.view(np.uint64)).all()
    assert bitmap.holds(bits, outside.view(np.uint64)).mean() < 0.05


def test_fm_index_counts(monkeypatch):
    from collections import Counter
    r = np.random.default_rng(2)
    base = r.integers(0, 6, 200).astype(np.uint64)
    segments = [base[a:a + int(r.integers(3, 60))].copy() for a in r.integers(0, 140, 12)]
    index = fmindex.FMIndex(segments, 35)
    count = Counter(tuple(s[i:i + n]) for s in segments for n in range(1, 36) for i in range(len(s) - n + 1))
    for k, s in enumerate(segments):
        for e, got in enumerate(index.longest(index.starts[k] + np.arange(1, len(s) + 1), 2, 35), 1):
            n = 0
            while n < 35 and e - n - 1 >= 0 and count[tuple(s[e - n - 1:e])] >= 2:
                n += 1
            assert n == got


@pytest.fixture(scope="module")
def copied():
    r = random.Random(3)
    shared = [prose(r, 60) for _ in range(4)]
    rows = []
    for k in range(160):
        text = prose(r, r.randint(0, 150))
        if k % 3 == 0:
            text += " " + r.choice(shared)[: r.randint(150, 400)] + " " + prose(r, 5)
        if k % 10 == 9:
            w = rows[-1][1].split()
            if w:
                w[r.randrange(len(w))] = "other"
            text = " ".join(w)
        rows.append((k, text))
    near = prose(r, 120).split()
    for k in range(60):     # one large group of near copies
        w = list(near)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
        rows.append((300 + k, " ".join(w)))
    rows += [(500 + k, rows[20][1]) for k in range(30)] + [(600, "is it " * 200), (601, shared[0]), (602, "a b " * 16 + "a b c")]
    return rows


@pytest.mark.parametrize("span,shard", [(35, 1 << 20), (35, 300), (12, 2000)])
def test_repeated_windows(documents, copied, span, shard):
    rows = copied + [(700 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in substrings.digests(substrings.deduplicated(documents(rows).repartition(3), span, shard)).collect()}
    assert got == dict(zip((d for d, _ in rows), brute.windows_removed([t for _, t in rows], span), strict=True))


def test_repeated_rows_and_ids(documents):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (None, text + " x"), (None, None), (2, "y " * 34)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.deduplicated(documents(rows)).collect())
    assert got == [(0, 0, 0), (0, 51, 50), (1, 50, 50), (1, 50, 50), (2, 34, 0)]
    assert substrings.deduplicated(documents([])).count() == 0


def test_parts_of_long_texts(documents, monkeypatch):
    monkeypatch.setattr(substrings, "PART_WORDS", 100)
    buf = " ".join(f"w{k % 977}" for k in range(3000))
    import pyarrow as pa
    column = texts(pa.array([buf]))
    seen = [f + k for _, _, first, n, _, _ in substrings._segments(*column, 35) for f, m in zip(first, n, strict=True) for k in range(m)]
    assert sorted(seen) == list(range(3000 - 34))


@pytest.mark.parametrize("rows", [1024, 7])
def test_jaccard_groups(documents, copied, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    every = copied + [(700 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.digests(ngram_join.groups(documents(every))).collect()}
    assert got == brute.jaccard_groups(every)
    assert len({c for c, _, _ in got.values()}) < len(got) - 60


def test_jaccard_groups_with_empty_blocks(documents, copied, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_RUNS", 40)     # more blocks than rows, so some are empty
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.digests(ngram_join.groups(documents(copied))).collect()}
    assert got == brute.jaccard_groups(copied)


def test_jaccard_of_repeated_rows(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words of that id"), (None, "a b c d e f"), (None, None), (2, "")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.groups(documents(rows)).collect())
    assert got == [(0, 0, 0), (0, 0, 2), (1, 0, 2), (1, 0, 2), (1, 1, 0), (2, 2, 0)]
    assert ngram_join.groups(documents([])).count() == 0


def test_pruning_tolerance():
    for n in (32, 64, 96):
        m = ngram_join.fewest_matches(n, 0.8, 1e-6)
        r = np.random.default_rng(n)
        j = r.random(200000)
        s = r.binomial(n, j)
        assert not (j[s < m] >= 0.8).any() and 0.3 * n < m < 0.7 * n


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(1299, 150), (5000, 4999), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [*range(201), *range(1000, 1300)]} == {0} and got[5000] == got[4999] == 4999 and 7 in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def leaky():
    r = random.Random(5)
    items = [(k, prose(r, r.randint(8, 50)).capitalize() + ".") for k in range(40)] + [(90, "too short"), (91, None), (None, prose(r, 30))]
    items.append((95, items[3][1]))     # the same words under another id
    rows = []
    for k in range(150):
        text = prose(r, r.randint(0, 80))
        if k % 2:
            w = items[k % 40][1].split()
            if k % 3 == 0:
                w[len(w) // 2] = "changed"
            if k % 5 == 0:
                w = w[:len(w) // 2]
            text += "\n" + " ".join(w) + " " + prose(r, 10)
        rows.append((k, text))
    return rows, items


def test_overlaps_with_the_benchmark(spark, documents):
    rows, items = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as seed")
    got = decontamination.contaminated(documents(rows + [(700 + k, t) for k, (_, t) in enumerate(ODD)]), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs) == len(got)
    assert pairs == brute.leaks(rows, [i for i in items if i[0] is not None])
    text, bench_words = dict(rows), {i: brute.plain_words(t) for i, t in items}
    for r in got:
        a, b = brute.plain_words(text[r.doc_id])[r.doc_start:][:r.n_words], bench_words[r.item_id][r.item_start:][:r.n_words]
        assert sum(x == y for x, y in zip(a, b, strict=True)) == r.n_matched >= 0.8 * r.n_words


def test_no_stretch_of_the_share_lacks_a_seed():
    from itertools import combinations
    for n in range(8, 21):
        need = min(13, -(-n * 4 // 5))
        for gone in (g for k in range(n // 5 + 1) for g in combinations(range(n), k)):
            agree = [x not in gone for x in range(n)]
            if sum(agree) >= max(need, 0.8 * n):
                assert any(all(agree[at + k] for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS for at in range(n - len(m) + 1)), (n, gone)


def test_best_stretch():
    r = np.random.default_rng(7)
    for _ in range(300):
        agree = r.random(r.integers(1, 40)) < 0.75
        total = np.concatenate([[0], np.cumsum(agree)])
        want = max([total[e] - total[s] for s in range(len(total)) for e in range(s, len(total)) if total[e] - total[s] >= 0.8 * (e - s) - 1e-9])
        start, end, n = decontamination._best(agree, 0.8)
        assert n == want == agree[start:end].sum() and n >= 0.8 * (end - start) - 1e-9


def test_leaks_of_odd_tables(spark, documents):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string")
    text = " ".join(f"w{k}" for k in range(30))
    got = decontamination.contaminated(documents([(1, text), (1, text), (None, text), (2, None)]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_matched) for r in got) == [(0, 30), (1, 30), (1, 30)]
    assert decontamination.contaminated(documents([]), bench).count() == 0
    assert decontamination.contaminated(documents([(1, text)]), bench.limit(0)).count() == 0


def test_stages_on_odd_documents(spark, documents, tmp_path):
    r = random.Random(11)
    toxic = [(k, prose(r, 20) + (" stupidtrash" if k % 4 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(f"b{k}" for k in range(25))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = toxic + [(700 + k, t) for k, t in ODD] + [(400, "near " + " ".join(f"c{k}" for k in range(60))), (401, " ".join(f"c{k}" for k in range(60))),
                          (402, prose(r, 9) + " " + item), (403, "my token = abcdefghijklmnop now"), (403, "my token = abcdefghijklmnop now")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left, names = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == names
    kept = {x.doc_id: x.text for x in left.collect()}
    assert left.count() == len(kept)
    assert {701, 702, 703, 705, 706, 400, 403} <= set(kept) and not {704, 401, 402} & set(kept)
    assert not any(k % 4 == 0 for k in kept if k < 300) and len([k for k in kept if k < 300]) > 215
    assert kept[403] == "my [assign] now"
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)


def test_stages_on_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and stages.packing is corpus_pipeline.STAGES[-1][1]
