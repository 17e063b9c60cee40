"""A written search index: distinct words, their lots, and the trigrams and deletions that lead to words.

Lots are searched by folded fields. What repeats is the words, so the index is over distinct words:

* ``lots``: word, field and lot, by word_band (a hash of the word); ``keys`` holds a lot's type;
* ``words``: word_id (the word's place in their order) and word;
* ``grams``: for each trigram the words that hold it, word_ids sorted and delta-coded in blocks, by gram_part;
* ``cuts``: for each word of up to CUT_LETTERS what is left with up to MOST_CUTS letters taken out, by cut_part.

``gram_part``, ``cut_part`` and ``word_band`` are partition columns. A search knows its trigrams and deletions beforehand,
so it reads the parts that can hold them and nothing else; candidates are then compared with the token itself, so the
result is that of a scan. A hot word is one word in the last three tables, and its lots are rows of their own, which are
shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import shared_dir
from .common import positions, written_once
from .search import TOLERANCE

FIELDS = ("title", "subcategory", "lot_number", "description", "category_path")
#: Fields whose words a typo-tolerant search compares; the others are matched exactly.
SHORT = FIELDS[:3]
PARTS, BLOCK = 64, 512
#: A word is found by its deletions up to this many edits, which words of CUT_LETTERS at most can be of a token. An edit
#: changes three trigrams at most, so the trigrams that are left lead to words of tokens that may have more edits.
MOST_CUTS = 1
CUT_LETTERS = int((MOST_CUTS + 1) / TOLERANCE) - 1 + MOST_CUTS


def _part(key: Column, parts: int) -> Column:
    """Part of a key, by digits that the driver can work out too."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("int"), F.lit(parts))


def _band(word: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")


def part_of(key: str, parts: int) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:7], 16) % parts


def _fields(lots: DataFrame) -> Column:
    """(field, folded text) of every searched field that the lots have."""
    one = lambda c: F.array_join("category_path", " ") if c == "category_path" else F.col(c)
    return F.array(*(F.struct(F.lit(k).alias("field"), text.fold_text(one(c)).alias("body"))
                     for k, c in enumerate(FIELDS) if c in lots.columns))


def _trigrams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3))))


def _cuts(word: Column) -> Column:
    """What is left of a word with up to MOST_CUTS letters taken out."""
    found = F.array(word)
    for _ in range(MOST_CUTS):
        shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                                        lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
    return found


def cuts_of(word: str, most: int = MOST_CUTS) -> list[str]:
    return sorted({"".join(c for i, c in enumerate(word) if i not in gone) for n in range(min(most, len(word)) + 1)
                   for gone in combinations(range(len(word)), n)})


def build(lots: DataFrame, key: Sequence[str] = ("lot_number",), path: str | None = None, parts: int = PARTS) -> str:
    """Writes the index of the lots to a new folder and returns it. ``key`` is what names a lot."""
    spark = lots.sparkSession
    path = path or shared_dir(spark, "search")
    # Two equal columns would clash: a lot's key is kept as one struct.
    held = lots.select(F.struct(*key).alias("lot"), F.explode(_fields(lots)).alias("f"))
    held.select("lot").limit(0).write.parquet(f"{path}/keys")
    spoken = held.select("lot", "f.field", F.explode(F.array_distinct(F.split("f.body", r"\s+"))).alias("word")).where("word <> ''")
    # A band takes a word with all its lots; a hot word is dealt over eight of its tasks.
    spoken = spoken.withColumn("word_band", _band(F.col("word"), parts)).repartition("word_band", F.pmod(F.xxhash64("lot"), F.lit(8)))
    spoken.write.partitionBy("word_band").parquet(f"{path}/lots")
    distinct = Index(spark, path, parts)._read("lots").select("word").distinct()
    (positions(distinct, [F.col("word")], "word_id").select("word_id", "word").write.parquet(f"{path}/words"))
    # A few files of words become many rows: dealt out first, as their bytes would give few tasks.
    words = spark.read.parquet(f"{path}/words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word_id")

    def save(df: DataFrame, name: str, column: str) -> None:
        df.write.partitionBy(column).parquet(f"{path}/{name}")

    grams = (words.select("word_id", F.explode(_trigrams(F.col("word"))).alias("gram"))
             .withColumn("gram_part", _part(F.col("gram"), parts)))
    # A trigram of many words has its list in blocks, so that none holds more than about BLOCK of them.
    sizes = grams.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    listed = (grams.join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("word_id"), F.col("blocks")))
              .groupBy("gram_part", "gram", "block").agg(F.array_sort(F.collect_list("word_id")).alias("_ids")))
    gaps = F.transform("_ids", lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at("_ids", F.greatest(i, F.lit(1)))))
    save(listed.select("gram_part", "gram", "block", gaps.alias("gaps")).repartition("gram_part"), "grams", "gram_part")
    near = (words.where(F.length("word") <= CUT_LETTERS).select("word_id", F.explode(_cuts(F.col("word"))).alias("cut"))
            .withColumn("cut_part", _part(F.col("cut"), parts)))
    save(near.repartition(F.col("cut_part")), "cuts", "cut_part")
    return path


class Index:
    """A built index: ``exact`` and ``fuzzy`` give the key of every lot that matches, as a scan would."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts

    def _read(self, name: str) -> DataFrame:
        # Types are given, as a table by parts has no file if it has no row.
        lot = self.spark.read.parquet(f"{self.path}/keys").schema["lot"].dataType.simpleString()
        kinds = {"words": "word_id bigint, word string", "grams": "gram string, block bigint, gaps array<bigint>, gram_part int",
                 "cuts": "word_id bigint, cut string, cut_part int", "lots": f"lot {lot}, field int, word string, word_band int"}
        return self.spark.read.schema(kinds[name]).parquet(f"{self.path}/{name}")

    def _holding(self, token: str) -> DataFrame:
        """Words that contain a token: those in the lists of all its trigrams, then compared; short tokens try every word."""
        words = self._read("words")
        grams = sorted({token[i:i + 3] for i in range(len(token) - 2)})
        if not grams:
            return words.where(F.contains("word", F.lit(token))).select("word_id", "word")
        return self._with_grams(grams, len(grams)).where(F.contains("word", F.lit(token)))

    def _with_grams(self, grams: Sequence[str], least: int) -> DataFrame:
        """Words that hold at least ``least`` of these trigrams."""
        mine = F.col("gram").isin(grams) & F.col("gram_part").isin(sorted({part_of(g, self.parts) for g in grams}))
        undone = F.aggregate("gaps", F.array().cast("array<bigint>"), lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))
        met = (self._read("grams").where(mine).select("gram", F.explode(undone).alias("word_id"))
               .groupBy("word_id").agg(F.count("*").alias("n")).where(F.col("n") >= least))
        return met.join(self._read("words"), "word_id").select("word_id", "word")

    def _near(self, token: str) -> DataFrame:
        """Words within TOLERANCE of a token: by what both leave when letters are taken out, or by the trigrams that must be left."""
        edits = int(TOLERANCE * len(token))
        words = self._read("words")
        close = (F.abs(F.length("word") - len(token)) <= edits) & (F.levenshtein("word", F.lit(token), edits) >= 0)
        if edits > MOST_CUTS or len(token) + edits > CUT_LETTERS:
            grams = sorted({token[i:i + 3] for i in range(len(token) - 2)})
            left = len(grams) - 3 * edits
            return (self._with_grams(grams, left) if left > 0 else words).where(close).select("word_id", "word")
        cuts = cuts_of(token, edits)
        mine = F.col("cut").isin(cuts) & F.col("cut_part").isin(sorted({part_of(c, self.parts) for c in cuts}))
        return self._read("cuts").where(mine).select("word_id").distinct().join(words, "word_id").where(close).select("word_id", "word")

    def _lots(self, found: DataFrame, fields: Sequence[int] | None = None) -> DataFrame:
        """Lots (and fields) of some words; the bands to read are known from the words themselves."""
        bands = [r[0] for r in found.select(_band(F.col("word"), self.parts).alias("b")).distinct().collect()]  # at most ``parts``
        held = self._read("lots").where(F.col("word_band").isin(bands or [-1]))
        if fields is not None:
            held = held.where(F.col("field").isin(list(fields)))
        return held.join(found.select("word"), "word", "left_semi").select("lot").distinct()

    def exact(self, query: str) -> DataFrame:
        """Lots that hold every token of the query somewhere in their fields."""
        tokens = text.tokens_of(query)
        return self._every([self._lots(self._holding(t)) for t in tokens])

    def fuzzy(self, query: str) -> DataFrame:
        """Lots with every token, or a word near it, in a short field, or with every token in the long ones."""
        tokens = text.tokens_of(query)
        short, rest = range(len(SHORT)), range(len(SHORT), len(FIELDS))
        near = self._every([self._lots(self._holding(t).unionByName(self._near(t)).distinct(), short) for t in tokens])
        return near.unionByName(self._every([self._lots(self._holding(t), rest) for t in tokens])).distinct()

    def _every(self, found: list[DataFrame]) -> DataFrame:
        if not found:
            return self._read("lots").where("false").select("lot.*")
        return reduce(lambda a, b: a.join(b, "lot", "left_semi"), found).select("lot.*")
