"""The registered queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (crossentropy, decontamination, idfile, licences, linecrf, ngram_join, oracles, packing, rtree, secrets,
               spelling, substrings, topk, toxicity)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_top_k", oracles.TOP_K)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.search(vectors.where("vec_id % 20 = 0"), vectors, k=20, scale=64.0)


@query("op2_token_files")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return idfile.roundtrip(table(spark, folder, "documents"))


@query("op3_licences", licences.oracle())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digests(licences.scan(table(spark, folder, "documents")))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, folder, "documents"), remembered=packing.REMEMBERED))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digests(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_spaced_seeds", oracles.benchmark_overlaps())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_cross_entropy_difference")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return crossentropy.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_linked_secrets", oracles.linked_secrets())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, folder, "documents")))


@query("op9_repeated_windows", oracles.repeated_windows(substrings.SPAN))
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(substrings.deduplicated(table(spark, folder, "documents")))


@query("op10_ngram_jaccard", oracles.jaccard_groups(ngram_join.WIDTH, ngram_join.THRESHOLD))
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.digests(ngram_join.groups(table(spark, folder, "documents")))


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = rtree.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op12_spelling_variants", oracles.spelling_variants())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_line_quality")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return linecrf.digests(table(spark, folder, "documents"), table(spark, folder, "labels"))
