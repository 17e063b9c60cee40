"""The parcels that bigrams are sent in."""

import numpy as np
import pyarrow as pa

from lotlens.llm import crossentropy


def test_a_parcel_gives_back_what_was_sent_and_packs_hashes_by_their_gaps():
    rng = np.random.default_rng(3)
    up = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    n = len(up)
    sent = [up, np.repeat(rng.integers(0, 300, 40), n // 10 + 1)[:4 * n], np.ones(n, "<i4"), np.arange(n, dtype="<i4") % 70, np.ones(n, "<i4"), rng.integers(-9, 9, 70), np.ones(70, "i1")]
    gaps = np.diff(up, prepend=np.uint64(0))
    bucket, size, data = crossentropy._parcel(4, (n, n, 70), gaps, *sent[1:])
    head, got = crossentropy._opened(size, data)
    assert bucket == 4 and head == (n, n, 70) and all(np.array_equal(a, b) for a, b in zip(got, sent, strict=True))
    plain = b"".join(np.ascontiguousarray(x).tobytes() for x in sent)
    assert len(data) < 0.8 * len(pa.compress(plain, codec="zstd", asbytes=True))
    nothing = [np.empty(0, k) for k in ("<i8", "<i8", "<f8", "<f8")]
    assert all(len(x) == 0 for x in crossentropy._opened(*crossentropy._parcel(0, (-1, 0, 0), *nothing)[1:])[1])


def test_bigrams_of_broadcast_words_are_sent_by_the_places_of_their_words(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 200))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(doc_id) as _h", "doc_id % 3 = 0 as target", "text")
    every = {r.h: (r.n0, r.n1) for r in crossentropy._word_counts(docs).collect()}
    mark = every.pop(int(crossentropy._MARK.view(np.int64)))
    keys = np.array(sorted(every, key=lambda h: h % (1 << 64)), np.int64)
    n = tuple(sum(x) for x in zip(*every.values(), strict=True))
    model = crossentropy.Words((keys.view(np.uint64), np.array([every[h] for h in keys.tolist()])), (0, 0), mark, n, len(keys) + 1)
    told = docs.selectExpr("*", "cast(array() as array<struct<h:bigint,n0:bigint,n1:bigint>>) as rare").coalesce(2)
    parcels = crossentropy._sent(told, model, (np.empty(0, np.uint64), np.empty((0, 2), np.int64)), 3).cache()
    # Nearly every bigram is met once: its hash and the counts of its words would take some 10 bytes alone.
    assert parcels.selectExpr("sum(length(data))").first()[0] < 7 * 200 * len(rows)
    # Losses go back as one row for each bucket and round, not for each document.
    back = crossentropy._lost(parcels, model)
    assert back.count() <= parcels.count()
    got = {r.h: r.n for r in crossentropy._added(back).collect()}
    assert len(got) == len(rows) and set(got.values()) == {200}
    pair, counts, name = model.bigrams(keys.view(np.uint64), np.array([0, 5, len(keys)]), (keys[:0].view(np.uint64), np.empty((0, 2), np.int64)))
    assert (name >= 0).all() and np.array_equal(model.counts(name), counts) and len(np.unique(name)) == len(np.unique(pair))
