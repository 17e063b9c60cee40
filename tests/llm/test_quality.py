"""Operator 13: marginals against all labellings, figures of lines against plain counting, and held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from lotlens.llm import linecrf


def test_marginals_equal_all_labellings():
    g = np.random.default_rng(1)
    sizes = [1, 2, 5, 7, 1, 3]
    s, pairs = g.normal(size=sum(sizes)) * 2, g.normal(size=(2, 2))
    row = np.repeat(np.arange(len(sizes)), sizes)
    first, last = np.diff(row, prepend=-1) != 0, np.diff(row, append=-1) != 0
    good, joint = linecrf.messages(s, pairs, first, last)
    at = 0
    for n in sizes:
        weights, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s[at + i] * v for i, v in enumerate(y)) + sum(pairs[a, b] for a, b in itertools.pairwise(y)))
            weights += w
            one += w * np.array(y)
            for i, (a, b) in enumerate(itertools.pairwise(y)):
                two[i, a, b] += w
        assert np.allclose(good[at:at + n], one / weights) and np.allclose(joint[at:at + n], two / weights)
        at += n


def test_long_chains_stay_finite():
    n = 20_000
    first, last = np.arange(n) == 0, np.arange(n) == n - 1
    good, joint = linecrf.messages(np.where(np.arange(n) % 2, 40.0, -40.0), np.array([[3.0, -3.0], [-3.0, 3.0]]), first, last)
    assert np.isfinite(good).all() and np.isfinite(joint).all() and good[1] > 0.99 and good[2] < 0.01


def arrays(rows):
    raw = [t.encode() for t in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def share(x):
    return int(np.digitize(x, linecrf.SHARES, right=True))


def test_bins_of_lines():
    rows = ["One two two 2!\n\n  \nOne two two 2!\r\nA|B", "", "\n\n", "éé 中文\n", "x y z x y z x y z"]
    x = linecrf.lines(*arrays(rows))
    assert x.row.tolist() == [0, 0, 0, 3, 4] and x.size.tolist() == [14, 15, 3, 5, 17]
    one = x.bins[0]
    assert one[1] == share(1 / 9) and one[2] == share(1 / 14) and one[3] == share(1 / 14) and one[8] == 2 and one[10] == share(1 / 4)
    assert x.bins[:, 12].tolist() == [1, 1, 1, 1, 1] and x.bins[2][4] == share(1 / 3) and x.bins[3][13] == share(4 / 5)
    assert x.bins[4][11] == share(6 / 9) and x.bins[4][10] == 0
    assert linecrf.lines(*arrays(["a\nb\na\na"])).bins[:, 12].tolist() == [3, 1, 3, 3]


def test_blocks_and_rounds_change_nothing(monkeypatch):
    g = random.Random(2)
    rows = ["\n".join("".join(g.choice("ab C1!|#é ") for _ in range(g.randint(0, 40))) for _ in range(g.randint(0, 9))) for _ in range(50)]
    whole = linecrf.lines(*arrays(rows))
    monkeypatch.setattr(linecrf, "_BLOCK", 7)
    some = linecrf.lines(*arrays(rows))
    assert (whole.bins == some.bins).all() and (whole.row == some.row).all()
    for k, t in enumerate(rows):
        alone = linecrf.lines(*arrays([t]))
        assert (alone.bins == whole.bins[whole.row == k]).all() and (alone.size == whole.size[whole.row == k]).all()


def document(g, good):
    def line():
        return " ".join("".join(g.choice("aeiourtnsl") for _ in range(g.randint(2, 8))) for _ in range(g.randint(4, 12))).capitalize() + "."

    def junk():
        return g.choice([lambda: line().upper().replace(" ", "!! "), lambda: " | ".join(line().split()), lambda: " ".join([g.choice(["foo", "bar"])] * 12)])()
    return "\n".join(line() if good or g.random() < 0.3 else junk() for _ in range(g.randint(2, 9))) if good else "\n".join([line(), junk(), junk()])


@pytest.fixture(scope="module")
def toy(spark):
    g = random.Random(7)
    rows = [(i, document(g, i % 4 != 1)) for i in range(400)]
    labels = [(i, int(i % 4 != 1), 0) for i in range(400) if i % 3]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark, toy):
    rows, labels = toy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linecrf.digests(df, labels).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [i for i in got if got[i].held_out]
    assert len(out) > 40 and all(got[i].predicted == int(i % 4 != 1) for i in out)


def test_nothing_of_held_out_rows_is_learned(spark, toy):
    rows, labels = toy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = linecrf.train(df, labels), linecrf.train(df, other)
    assert (a.weights == b.weights).all() and (a.pairs == b.pairs).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_awkward_rows(spark, toy):
    rows, labels = toy
    more = [(None, None), (1000, ""), (1001, " \n\t\n"), (1002, "x" * 3_000_000), (1003, "word\n" * 300_000), (1004, "!!!"), (1004, "!!!"), (None, "plain text")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string").selectExpr(
        "*", "'x' as score", "2 as bins", "3 as good", "4 as row", "5 as n_lines", "6 as sizes", "7 as quality")
    bad = labels.selectExpr("*", "'y' as text", "1 as good").unionByName(
        spark.createDataFrame([(None, 1, 0, "", 1), (3, None, 0, "", 1)], "doc_id long, quality int, toxic int, text string, good int"))
    got = linecrf.digests(df, bad).collect()
    assert len(got) == 408 and all(0 <= r.score <= 1 for r in got)
    share = {round(r.score, 12) for r in got if r.doc_id in (1000, 1001)}
    assert len(share) == 1 and [r.held_out for r in got if r.doc_id is None] == [False, False]
    twice = [r.score for r in got if r.doc_id == 1004]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_tables_without_rows_or_classes(spark, toy):
    rows, labels = toy
    df = spark.createDataFrame(rows[:5], "doc_id long, text string")
    assert {r.score for r in linecrf.digests(df, labels.limit(0)).collect()} == {0.5}
    one = labels.where("quality = 1")
    assert len({r.score for r in linecrf.digests(spark.createDataFrame(rows, "doc_id long, text string"), one).collect()}) == 1
    assert linecrf.digests(df.limit(0), labels).collect() == []


def test_sample_bounds_hold(spark, toy):
    rows, labels = toy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = linecrf.train(df, labels, most_rows=40, most_lines=200, long_row=20)
    got = linecrf.score(df, small).collect()
    assert small.fitted and sum(int(r.score >= 0.3) == int(r.doc_id % 4 != 1) for r in got) >= 390


def test_line_marginals_match_the_score(spark, toy):
    rows, labels = toy
    df = spark.createDataFrame(rows[:20], "doc_id long, text string")
    field = linecrf.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    lines = linecrf.line_marginals(df, field).toPandas()
    for r in linecrf.score(df, field).collect():
        mine = lines[lines.doc_id == r.doc_id].sort_values("line")
        assert mine.line.tolist() == list(range(len([t for t in r.text.split("\n") if t.strip()])))
        mean = np.clip((mine["size"] * mine.good).sum() / mine["size"].sum(), 1e-4, 1 - 1e-4)
        assert abs(1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift))) - r.score) < 1e-9


def test_the_fit_of_the_toxicity_classifier_needs_little_memory_on_the_driver():
    import tracemalloc

    from lotlens.llm import toxicity
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 4000, 150)).astype(np.int32) for _ in range(6000)]
    toxic = np.array([float((s < 300).sum() > 11) for s in sets])
    scale = rng.normal(size=4000)
    tracemalloc.start()
    w, b = toxicity._fit(sets, toxic, scale, steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # 880,000 features, of which eight bytes each for column, row, value and scratch arrays take 40 MB

    def loss(w, b):
        z = np.array([scale[s] @ w[s] for s in sets]) + b
        return (np.logaddexp(0, z) - toxic * z).mean() + 0.5e-3 * (w @ w)

    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    assert loss(w, b) < loss(np.zeros(4000), np.log(share / (1 - share)))


def test_buckets_are_chosen_by_evidence_as_over_the_whole_table(monkeypatch):
    from lotlens.llm import toxicity
    rng = np.random.default_rng(6)
    counts, sizes = np.zeros((2, toxicity.BUCKETS), np.int64), np.array([900, 100])
    at = rng.choice(toxicity.BUCKETS, 5000, replace=False)
    counts[0, at], counts[1, at] = rng.integers(0, 200, 5000), rng.integers(0, 60, 5000)
    best, ratio = toxicity._chosen(counts, sizes, 1.0)
    clean, toxic = (counts + 1.0) / (sizes + 2.0)[:, None]
    pooled = (counts.sum(0) + 1.0) / (sizes.sum() + 2.0)
    sure = np.abs(toxic - clean) / np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    sure[counts.sum(0) < 3] = 0
    want = np.lexsort((np.arange(toxicity.BUCKETS), -sure))[:max(100, int((sure > toxicity.EVIDENCE).sum()))]
    assert np.array_equal(best, np.sort(want)) and np.allclose(ratio, np.log(toxic / clean)[best], atol=1e-15)
