"""Operator 2: token ids of documents in a compressed binary file format, and back.

A file set is three Parquet tables in one folder of the shared store:

* ``frequencies``: id, count. One table for all blocks, counted over all ids.
* ``shards``: shard, start (ids before it), n_tokens. Shards follow the order of the documents.
* ``blocks``: independent runs of ids, coded by a static range asymmetric numeral system (``rans``) with interleaved
  lanes and checkpoints from which a reader may start; checksums of the coded and of the plain ids; and which
  documents lie in the block, so that any block can be read alone and any set of blocks at the same time.

Documents are dealt out by range, so a shard holds neighbours only, and ids lie in ascending order of
(doc_id, hash of the text, text); rows without id come first. Repeated rows are written one by one; a null text is an
empty one and has the end id alone. An empty table gives empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import common, rans, tokens

END_ID = 2
#: Runs of text that a worker remembers: encoding has the worker to itself here.
REMEMBERED = 800_000
#: More ids than any vocabulary of the supported tokenizers; the frequency table passes through the driver.
MOST_IDS = 1 << 20

_SHARDED = pa.schema([("shard", pa.int64()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
                      ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCKS = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()),
                     ("states", pa.binary()), ("places", pa.binary()), ("words", pa.binary()),
                     ("words_crc32", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES = pa.schema([("shard", pa.int64()), ("doc_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                     ("first", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
#: What a block says of each document in it: whether it has an id, the id, its first place in the shard, its length.
_DOC = np.dtype([("known", "<i8"), ("doc_id", "<i8"), ("start", "<i8"), ("n", "<i8")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in schema)


def sharded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Ids of each document in its shard, and a last row of each shard with the counts of its ids."""
    end = int(end_id).to_bytes(4, "little")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.encoder(tokenizer, REMEMBERED), TaskContext.get().partitionId()
        counts = np.zeros(1 << 16, np.int64)

        def rows() -> Iterator[tuple]:
            nonlocal counts
            at = 0
            for part in parts:
                ids, column = part.column("doc_id"), part.column("text")
                _, off = common.texts(column)
                for lo, hi in common.rounds(off, 1 << 18):
                    bodies = [b + end for b in encoder.encode(column[lo:hi].to_pylist())]
                    both = np.frombuffer(b"".join(bodies), "<u4").astype(np.int64)
                    if len(both) and both.max() >= len(counts):
                        counts = np.concatenate([counts, np.zeros(int(both.max()) + 1 - len(counts), np.int64)])
                    seen = np.bincount(both, minlength=len(counts))
                    counts += seen
                    for doc, body in zip(ids[lo:hi].to_pylist(), bodies, strict=True):
                        ids16 = np.frombuffer(body, "<u4")
                        small = ids16.astype("<u2").tobytes() if ids16.max() < 1 << 16 else body
                        yield shard, at, doc, len(body) // 4, small, None
                        at += len(body) // 4
            if at:
                have = np.flatnonzero(counts)
                yield shard, at, None, -1, have.astype("<u4").tobytes(), counts[have].astype("<i8").tobytes()

        yield from common.batches(_SHARDED, rows())

    order = ["doc_id", "_h", "text"]
    return (common.text_rows(docs).repartitionByRange("doc_id", "_h").sortWithinPartitions(*order)
            .select("doc_id", "text").mapInArrow(work, _ddl(_SHARDED)))


def frequencies(shards: DataFrame) -> DataFrame:
    """id, count over all shards; one row for each id of the vocabulary at most."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for part in parts:
            for ids, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for i, n in zip(np.frombuffer(ids, "<u4").tolist(), np.frombuffer(counts, "<i8").tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["id", "count"])

    return (shards.where("counts is not null").select("ids", "counts").mapInArrow(work, "id long, count long")
            .groupBy("id").agg(F.sum("count").alias("count")))


def _table(freq: DataFrame) -> tuple[np.ndarray, rans.Table | None]:
    rows = freq.orderBy("id").limit(MOST_IDS + 1).toPandas()
    if len(rows) > MOST_IDS:
        raise ValueError(f"over {MOST_IDS} distinct ids: no tokenizer's vocabulary")
    ids = rows["id"].to_numpy(np.int64)
    return ids, rans.Table(rows["count"].to_numpy(np.int64)) if len(ids) else None


def _blocks(shards: DataFrame, freq: DataFrame) -> DataFrame:
    known, table = _table(freq)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(int(known[-1]) + 1 if len(known) else 1, np.int32)
        code[known] = np.arange(len(known))

        def out(shard: int, first: int, docs: list, bodies: list) -> Iterator[tuple]:
            ids = np.concatenate(bodies)
            docs = np.array(docs, _DOC)
            at = 0
            for n, states, places, words in rans.encode(table, code[ids]):
                a, b = first + at, first + at + n
                some = docs[np.searchsorted(docs["start"] + docs["n"], a, "right"):np.searchsorted(docs["start"], b, "left")]
                plain = ids[at:at + n].astype("<u4").tobytes()
                yield shard, a, n, some.tobytes(), states, places, words, zlib.crc32(words), zlib.crc32(plain)
                at += n

        def rows() -> Iterator[tuple]:
            shard = first = at = None
            docs, bodies = [], []
            for part in parts:
                for s, start, doc, n, body, _ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if docs and (s != shard or start != at or at - first >= rans.AT_ONCE * rans.BLOCK):
                        yield from out(shard, first, docs, bodies)
                        docs, bodies = [], []
                    if not docs:
                        shard, first = s, start
                    docs.append((doc is not None, doc or 0, start, n))
                    bodies.append(np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype(np.int64))
                    at = start + n
            if docs:
                yield from out(shard, first, docs, bodies)

        yield from common.batches(_BLOCKS, rows())

    return shards.where("counts is null").mapInArrow(work, _ddl(_BLOCKS))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes the documents and writes the file set to a new folder."""
    save = lambda df, name: df.write.option("compression", "uncompressed").parquet(f"{path}/{name}")
    shards = common.saved(sharded(docs, tokenizer, end_id), "ids")
    save(frequencies(shards), "frequencies")
    totals = shards.where("counts is not null").select("shard", F.col("start").alias("n_tokens"))
    # A row for each shard, so as many as tasks; the shards before it make its start.
    totals.createOrReplaceTempView("_idfile_shards")
    save(docs.sparkSession.sql("select shard, n_tokens, sum(n_tokens) over (order by shard rows between unbounded "
                               "preceding and current row) - n_tokens as start from _idfile_shards"), "shards")
    docs.sparkSession.catalog.dropTempView("_idfile_shards")
    save(_blocks(shards, docs.sparkSession.read.parquet(f"{path}/frequencies")), "blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decodes a file set: a row for each part of a document in a block, with its ids and their checksum.

    ``doc_id``, ``shard``, ``doc_start`` (the document's place in the shard), ``n_tokens`` (of the document), ``first``
    (the part's place in the shard), ``length``, ``ids_crc32``, ``ids``. A block that fails a checksum raises.
    """
    known, table = _table(spark.read.parquet(f"{path}/frequencies"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for lo in range(0, part.num_rows, rans.AT_ONCE):
                    some = list(zip(*(c.to_pylist() for c in part.slice(lo, rans.AT_ONCE).columns), strict=True))
                    for b in some:
                        if zlib.crc32(b[6]) != b[7]:
                            raise ValueError(f"block {b[0]}:{b[1]} is damaged")
                    for b, codes in zip(some, rans.decode(table, [(b[2], b[4], b[5], b[6]) for b in some]), strict=True):
                        plain = known[codes].astype("<u4").tobytes()
                        if zlib.crc32(plain) != b[8]:
                            raise ValueError(f"block {b[0]}:{b[1]} does not give the ids that went in")
                        for has, doc, start, n in np.frombuffer(b[3], _DOC).tolist():
                            lo_id, hi_id = max(start, b[1]), min(start + n, b[1] + b[2])
                            ids = plain[4 * (lo_id - b[1]):4 * (hi_id - b[1])]
                            yield b[0], start, doc if has else None, n, lo_id, hi_id - lo_id, zlib.crc32(ids), ids

        yield from common.batches(_PIECES, rows())

    return spark.read.parquet(f"{path}/blocks").mapInArrow(work, _ddl(_PIECES))


def _times(m: list[int], v: int) -> int:
    out = 0
    for k in range(32):
        if v >> k & 1:
            out ^= m[k]
    return out


def _zeros() -> list[list[int]]:
    """What 2^k zero bytes after a text do to its crc32, as matrices over two elements."""
    bit = [0xEDB88320] + [1 << k for k in range(31)]
    square = lambda m: [_times(m, x) for x in m]
    byte = square(square(square(bit)))
    out = [byte]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


_ZEROS: list[list[list[int]]] = []


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of what lies end to end, from (crc32, bytes) of each part."""
    if len(parts) > 1 and not _ZEROS:
        _ZEROS.append(_zeros())
    total = parts[0][0]
    for crc, n in parts[1:]:
        k = 0
        while n:
            if n & 1:
                total = _times(_ZEROS[0][k], total)
            n >>= 1
            k += 1
        total ^= crc
    return total


def _joined(firsts: pd.Series, lengths: pd.Series, crcs: pd.Series) -> pd.Series:
    out = []
    for f, n, c in zip(firsts, lengths, crcs, strict=True):
        out.append(int(c[0]) if len(c) == 1 else
                   joined_crc32([(int(c[k]), 4 * int(n[k])) for k in np.argsort(f, kind="stable")]))
    return pd.Series(out, dtype="int64")


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the ids that the file set gives back."""
    parts = read(spark, path).drop("ids").groupBy("shard", "doc_start", "doc_id", "n_tokens").agg(
        *(F.collect_list(c).alias(c) for c in ("first", "length", "ids_crc32")))
    whole = F.pandas_udf(_joined, "long")
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("_before"))
    return (parts.join(shards, "shard")
            .select("doc_id", (F.col("_before") + F.col("doc_start")).alias("start"), "n_tokens",
                    whole("first", "length", "ids_crc32").alias("ids_crc32")))


def roundtrip(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents to a new file set in the shared folder and returns the index read from it."""
    path = shared_dir(docs.sparkSession, "idfile")
    write(docs, path, tokenizer, end_id)
    return index(docs.sparkSession, path)
