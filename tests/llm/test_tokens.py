"""Operators 2 and 4: exact round trips, and every id in one piece."""

import random

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from lotlens.llm import idfile, packing, rans, stages, tokens

ROWS = [(5, "the quick brown fox"), (3, None), (9, ""), (9, "  two  rows\n with one id \n\n"), (5, "the quick brown fox"),
        (None, "no id"), (12, "word " * 3000), (7, "ñandú <|endoftext|> 日本語\x1c　x"), (-4, "a" * 5000), (8, " ")]


def test_remembered_runs_give_the_library_s_ids():
    encoder, r = tokens.Encoder(tokens.vocabulary_file()), random.Random(1)
    untouched = Tokenizer.from_file(tokens.vocabulary_file())
    letters = ["a", "B", " ", " ", "\n", "\t", "é", "1", ".", "'s", "'", "  ", "　", "\x1c", "<|endoftext|>", "\x85", "ʼn", "\U0001f600"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["<|endoftext|> first", "last <|endoftext|>", "in<|endoftext|>side", "a <|endoftext|>  b <|endoftext|><|endoftext|>", "<|endoftext", "endoftext|>"]
    want = [x.ids for x in untouched.encode_batch(texts, add_special_tokens=False)]
    assert want[-6][0] == want[-5][-1] == 50256
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_remembered_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 20)
    encoder = tokens.Encoder(tokens.vocabulary_file())
    texts = [f"x w{k} w{k % 7} the" for k in range(200)]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert len(encoder.runs) <= 25 and len(encoder.runs.before) <= 25


@pytest.mark.parametrize("n", [1, 31, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 40 * rans.BLOCK + 77])
def test_coded_symbols_come_back(n):
    x = (np.random.default_rng(n).zipf(1.2, n) % 3000).astype(np.int64)
    known, codes, counts = np.unique(x, return_inverse=True, return_counts=True)
    table = rans.Table(counts)
    blocks = rans.encode(table, codes)
    assert sum(b[0] for b in blocks) == n and table.freq.min() >= 1
    assert (known[np.concatenate(rans.decode(table, blocks))] == x).all()
    some = blocks[len(blocks) // 2]  # any block is read alone
    assert (rans.decode(table, [some])[0] == codes[len(blocks) // 2 * rans.BLOCK:][:some[0]]).all()


def test_joined_checksums():
    import zlib
    parts = [b"", b"abc" * 4, b"x" * 1000, b"1234"]
    assert idfile.joined_crc32([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files_round_trip(documents):
    got = [tuple(r) for r in idfile.roundtrip(documents(ROWS)).orderBy("start").collect()]
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in rows]
    coded = {k: sorted((len(brute.ids(t, 2)), brute.crc(brute.ids(t, 2))) for d, t in ROWS if d == k) for k, _ in ROWS}
    assert {k: sorted(g[2:] for g in got if g[0] == k) for k in coded} == coded
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()


def test_damaged_block_is_noticed(spark, documents, tmp_path):
    idfile.write(documents(ROWS), f"{tmp_path}/a")
    blocks = spark.read.parquet(f"{tmp_path}/a/blocks").toPandas()
    blocks["words"] = [bytes([w[0] ^ 1]) + w[1:] for w in blocks["words"]]
    for t in ("frequencies", "shards"):
        spark.read.parquet(f"{tmp_path}/a/{t}").write.parquet(f"{tmp_path}/b/{t}")
    spark.createDataFrame(blocks, spark.read.parquet(f"{tmp_path}/a/blocks").schema).write.parquet(f"{tmp_path}/b/blocks")
    with pytest.raises(Exception, match="damaged"):
        idfile.index(spark, f"{tmp_path}/b").collect()


def test_documents_over_many_blocks(documents):
    rows = [(k, f"w{k} the of and " * (20000 if k == 1 else 10)) for k in range(4)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in idfile.roundtrip(documents(rows)).collect()}
    assert got == {k: (len(brute.ids(t, 2)), brute.crc(brute.ids(t, 2))) for k, t in rows}


def test_empty_tables(documents):
    assert idfile.roundtrip(documents([])).count() == 0
    assert packing.pack(documents([])).count() == 0


def test_pieces_do_not_depend_on_what_a_worker_remembers(documents):
    rows = [(k, " ".join(f"w{k * j % 97} the" for j in range(40))) for k in range(60)]
    found = [sorted(map(tuple, packing.digests(packing.pack(documents(rows).coalesce(1), remembered=n)).collect())) for n in (3, None)]
    assert found[0] == found[1]
    assert stages.REMEMBERED < tokens.GENERATION


@pytest.mark.parametrize("how", [{}, {"group_ids": 50, "most_open": 2}, {"window": 8, "slack": 0, "group_ids": 40, "most_open": 1}])
def test_each_id_lies_in_one_piece(documents, how):
    rows = ROWS + [(100 + k, "the " * (k * 37 % 90)) for k in range(60)]
    got = packing.pack(documents(rows).repartition(3), **how).collect()
    window = how.get("window", 1024)
    want = sorted(brute.ids(t, 0) for _, t in rows)
    whole = []
    for key in {(g.doc_id, g.doc_tokens) for g in got}:
        pieces = sorted((g for g in got if (g.doc_id, g.doc_tokens) == key), key=lambda g: g.start)
        copies = len([1 for d, t in rows if d == key[0] and len(brute.ids(t, 0)) == key[1]])
        assert sum(g.length for g in pieces) == copies * key[1]
        if copies == 1:
            assert [g.start for g in pieces] == np.concatenate([[0], np.cumsum([g.length for g in pieces])[:-1]]).tolist()
            whole.append(np.frombuffer(b"".join(g.ids for g in pieces), "<u4").tolist())
    assert all(w in want for w in whole)
    padding = 0
    for s in {g.sequence_id for g in got}:
        pieces = sorted((g for g in got if g.sequence_id == s), key=lambda g: g.offset)
        n = sum(g.length for g in pieces)
        assert n <= window
        assert [g.offset for g in pieces] == np.concatenate([[0], np.cumsum([g.length for g in pieces])[:-1]]).tolist()
        padding += 0 if n & (n - 1) == 0 else window - n
    assert padding <= 0.02 * sum(g.length for g in got)


def test_the_tightest_window_is_found():
    tree, r = packing.Capacities(64), random.Random(3)
    held = []
    for k in range(2000):
        if r.random() < 0.55:
            c = r.randint(0, 64)
            tree.put(c, k)
            held.append(c)
        else:
            need = r.randint(0, 64)
            fits = [c for c in held if c >= need]
            found = tree.tightest(need)
            assert (found and found[0]) == (min(fits) if fits else None) or (found and found[0] == 0 == min(fits))
            if found:
                held.remove(found[0])


def test_digests_are_checksums_of_the_ids(documents):
    got = packing.digests(packing.pack(documents([(1, "some words here")]))).collect()[0]
    want = brute.ids("some words here", 0)
    assert (got.doc_id, got.start, got.length, got.doc_tokens, got.offset, got.ids_crc32) == (1, 0, len(want), len(want), 0, brute.crc(want))
