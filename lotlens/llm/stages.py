"""The stages of the corpus pipeline: each takes (spark, docs, folder) and applies one operator to all of ``docs``.

All but the last return rows with the columns that they got. A row is known by its id and the hash of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, ngram_join
from . import packing as pack
from . import secrets as secret_scan
from . import toxicity as toxic

#: Keys of 16 bytes that one task may hold; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Runs of text that a worker of the last stage remembers: its executor still holds what the stages before took.
REMEMBERED = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows of documents (so that no name of theirs can clash) beside the key that the operators know them by."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("k_doc"),
                       F.xxhash64(F.lit(7), doc, text).alias("k_hash"))


def _met() -> Column:
    """A keyed document is the one that doc_id and _h name."""
    return F.col("k_doc").eqNullSafe(F.col("doc_id")) & (F.col("k_hash") == F.col("_h"))


def _keys(found: DataFrame, name: str) -> DataFrame:
    """The keys of a table, written once; broadcast if few enough, else joined by a shuffle of both sides."""
    keys = common.saved(found.select("doc_id", "_h").distinct(), name)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 5: documents that score below the threshold stay."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    model = toxic.train(docs, common.table(spark, folder, "labels"))
    return toxic.score(docs, model, name).where(F.col(name) < toxic.THRESHOLD).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 10: of each class of linked documents the one with the least id stays, once."""
    first = (F.col("_h") == F.col("class_h")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    marked = common.saved(ngram_join.groups(docs).groupBy("doc_id", "_h").agg(F.max(first).alias("first"), F.count("*").alias("n")), "marked")
    left = _keyed(docs).join(_keys(marked.where("not first"), "others"), _met(), "left_anti")
    twice = marked.where("first and n > 1")
    if twice.isEmpty():
        return left.select("row.*")
    repeated = _keys(twice, "repeated")
    once = (left.join(repeated, _met(), "left_semi").groupBy("k_doc", "k_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row")))
    return left.join(repeated, _met(), "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 6: documents that overlap no benchmark item stay."""
    found, _ = decontamination.overlaps(docs, common.table(spark, folder, "benchmark"))
    return _keyed(docs).join(_keys(found, "leaks"), _met(), "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 8: every document stays; its secrets are replaced by their kind in brackets."""
    found = common.saved(secret_scan.scan(docs).where(F.size("spans") > 0).distinct(), "spans")
    keys, rows = _keys(found, "holders"), _keyed(docs)
    clean = rows.join(keys, _met(), "left_anti").select("row")
    held = rows.join(keys, _met(), "left_semi").join(found, _met())
    text = secret_scan.redacted(F.col("row.text"), F.col("spans"))
    return clean.unionByName(held.select(F.col("row").withField("text", text).alias("row"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 4: the pieces of every document in sequences of 1024 ids."""
    return pack.digests(pack.pack(docs, remembered=REMEMBERED))
