"""Literal phrases in texts through the words that hold them: an equi-join whose cost doesn't grow with their number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written_once
from .skew import attach


def texts_with(texts: DataFrame, phrases: Sequence[tuple[str, Sequence[str], str]]) -> DataFrame:
    """``_row``, ``_body``, ``term`` and ``pattern`` of every text (_row, _body) that holds all tokens of a phrase.

    Phrases are (term, tokens, pattern), each term once. A token has no white space, so it lies within a word: each
    distinct word is taken apart into its pieces of the lengths that tokens have, and pieces meet tokens. A phrase is
    sought only in texts with a word that holds its rarest token, and compared there.
    """
    spark = texts.sparkSession
    listed = written_once(spark.createDataFrame([(t, list(k), p) for t, k, p in phrases if k], "term string, tokens array<string>, pattern string"), "phrases")
    lengths = sorted({len(k) for _, tokens, _ in phrases for k in tokens})
    spoken = texts.select("_row", F.explode(F.array_distinct(F.split("_body", r"\s+"))).alias("word")).where("word <> ''")
    words = written_once(spoken.groupBy("word").agg(F.count("*").alias("n")), "words")
    none = F.array().cast("array<string>")
    pieces = F.transform(F.array(*map(F.lit, lengths or [1])), lambda k: F.when(
        F.length("word") >= k, F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.substring("word", i, k))).otherwise(none))
    tokens = listed.select(F.explode("tokens").alias("token")).distinct()
    holders = written_once(attach(words.select("word", "n", F.explode(F.array_distinct(F.flatten(pieces))).alias("token")),
                                  tokens, ["token"], "inner"), "holders")
    seen = holders.groupBy("token").agg(F.sum("n").alias("_rows"))
    rarest = (listed.select("*", F.explode(F.array_distinct("tokens")).alias("token")).join(seen, "token")
              .groupBy("term", "tokens", "pattern").agg(F.min_by("token", F.struct("_rows", "token")).alias("token"), F.count("*").alias("_n"))
              .where(F.col("_n") == F.size(F.array_distinct("tokens"))).drop("_n"))
    rarest = written_once(rarest, "rarest")
    # A word holds no more tokens than it has pieces.
    led = (holders.join(rarest.select("token").distinct(), "token", "left_semi")
           .groupBy("word").agg(F.collect_set("token").alias("_tokens")))
    met = attach(spoken, led, ["word"], "inner").select("_row", F.explode("_tokens").alias("token")).distinct()
    return (met.join(rarest, "token").join(texts, "_row").where(F.forall("tokens", lambda k: F.contains("_body", k)))
            .select("_row", "_body", "term", "pattern"))
