"""Operator 8: secrets in texts by multipart credential linking, in DataFrame functions alone.

Parts are found by pattern. Strong secrets (``assign``, ``access``, ``hex``) are always reported. Weak candidates are
reported only where complementary parts stand together: a weak ``secret`` (a short or oddly named value) with an access
identifier or an endpoint in its scope, a weak ``identifier`` or an ``endpoint`` with a secret, strong or weak, in its
scope. Two parts are in one scope if they belong to one document and start at most REACH characters apart; they meet in
an interval join over bins of that length, and a bin holds no more parts than its characters.

Positions are code points, the end is exclusive. They are the running lengths of what lies between a pattern's matches
and of the matches themselves; running sums go by blocks, and what several steps need is a column of its own, computed
once, so that time grows with a text and its matches. Weak candidates that overlap a strong part are found in two passes over the
sorted parts of a document, forwards and backwards.

A null text is an empty one; documents without any span are reported with none. Repeated rows get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_rows

REACH = 256
_BLOCK = 512

#: kind, role, strong, pattern, group whose length counts, least length. The first three are fixed by the contract.
KINDS = (
    ("assign", "secret", True, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "identifier", True, r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "secret", True, r"[0-9a-f]{16,}", 0, 16),
    ("secret", "secret", False, r"""(?i:(pwd|passphrase|password|passwd|secret|private_?key|client_?secret|credential|bearer))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 4),
    ("identifier", "identifier", False, r"""(?i:(user_?name|user|login|account|client_?id|access_?key_?id|uid))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+@_.-]+)""", 2, 3),
    ("endpoint", "endpoint", False, r"""(?i:(https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|sftp|ftps?|ssh)):[a-z0-9:]*//([A-Za-z0-9.@:/_%?&=-]+)""", 2, 4),
)
BASE = tuple(k[0] for k in KINDS[:3])
ORDER = tuple(k[0] for k in KINDS)
_STRONG_SPAN = "array<struct<kind:string,role:string,strong:boolean,start:int,stop:int>>"


def _within(lengths: Column) -> Column:
    """Sums of what stands before each element of a short array of integers, and of all."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _steps(pattern: str, group: int) -> Column:
    """Lengths of what stands before each leftmost non-overlapping match (gap), of the match (n) and of its group (size).

    The last element is what follows them all; NULL without a match.
    """
    text, regex = F.col("text"), F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), F.length) if group else found
    steps = F.zip_with(gaps, F.arrays_zip(found.alias("n"), counted.alias("size")), lambda gap, m: F.struct(
        gap.alias("gap"), F.coalesce(m["n"], F.lit(0)).alias("n"), F.coalesce(m["size"], F.lit(-1)).alias("size")))
    return F.when(text.rlike(pattern), steps)


def _sums(steps: Column) -> Column:
    """Sums of what stands before each step within its block, and of the block."""
    last = F.floor((F.size(steps) - 1) / F.lit(_BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: _within(
        F.transform(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)), lambda s: s["gap"] + s["n"])))


def _spans(steps: Column, sums: Column, kind: str, role: str, strong: bool, least: int) -> Column:
    """The matches whose group isn't too short, with their places."""
    earlier = _within(F.transform(sums, lambda s: F.element_at(s, -1)))
    before = F.flatten(F.zip_with(sums, F.slice(earlier, F.lit(1), F.size(sums)), lambda s, plus: F.transform(
        F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + plus)))
    placed = F.zip_with(steps, before, lambda s, at: F.struct(
        (at + s["gap"]).alias("start"), (at + s["gap"] + s["n"]).alias("stop"), s["size"].alias("size")))
    rows = F.transform(F.filter(placed, lambda r: r["size"] >= least), lambda r: F.struct(
        F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(strong).alias("strong"), r["start"].alias("start"), r["stop"].alias("stop")))
    return F.coalesce(rows, F.array().cast(_STRONG_SPAN))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, _h, and the array ``parts`` (kind, role, strong, start, stop) of every document, weak candidates last.

    The columns between are read more than once by the next step, so they are kept and not computed again in it.
    """
    steps = text_rows(docs).select("doc_id", "_h", *(_steps(k[3], k[4]).alias(f"_{k[0]}") for k in KINDS))
    sums = steps.select("*", *(_sums(F.col(f"_{k}")).alias(f"_sums_{k}") for k in ORDER))
    spans = [_spans(F.col(f"_{kind}"), F.col(f"_sums_{kind}"), kind, role, strong, least) for kind, role, strong, _, _, least in KINDS]
    return sums.select("doc_id", "_h", F.concat(*spans).alias("parts"))


def _without_strong_ones(pool: DataFrame) -> DataFrame:
    """Parts without weak candidates that overlap a strong part: such a candidate is that part.

    A strong part that starts no later overlaps if it ends after the candidate's start, one that starts later if it does
    before the candidate's end. A window holds the parts of one document.
    """
    one = W.partitionBy("doc_id", "_h")
    forth = one.orderBy("start", F.desc("strong"), "kind", "stop").rowsBetween(W.unboundedPreceding, W.currentRow)
    back = one.orderBy(F.desc("start"), "strong", F.desc("kind"), F.desc("stop")).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = (pool.withColumn("_reached", F.max(F.when(F.col("strong"), F.col("stop"))).over(forth))
              .withColumn("_next", F.min(F.when(F.col("strong"), F.col("start"))).over(back)))
    covered = F.coalesce(F.col("_reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("stop"), F.lit(False))
    return marked.where(F.col("strong") | ~covered).drop("_reached", "_next")


def _complements(a: Column, b: Column) -> Column:
    """Whether part ``b`` makes the weak candidate ``a`` worth reporting."""
    return F.when(a == "secret", b.isin("identifier", "endpoint")).otherwise(b == "secret")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates of ``parts`` that have a complementary part in their scope: doc_id, _h, links.

    ``links`` lists kind, start and stop of each. A document is known by its id and the hash of its text.
    """
    roles = F.transform("parts", lambda p: p["role"])
    pool = (found.where(F.exists("parts", lambda p: ~p["strong"]) & F.array_contains(roles, "secret")
                        & (F.array_contains(roles, "identifier") | F.array_contains(roles, "endpoint")))
            .select("doc_id", "_h", F.explode("parts").alias("p")).distinct().select("doc_id", "_h", "p.*"))
    pool = _without_strong_ones(pool).withColumn("bin", F.floor(F.col("start") / reach))
    weak = (pool.where(~F.col("strong")).select(
        "doc_id", "_h", "kind", "role", "start", "stop",
        F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")))
    other = pool.select(F.col("doc_id").alias("o_doc"), F.col("_h").alias("o_h"), F.col("bin").alias("o_bin"),
                        F.col("role").alias("o_role"), F.col("start").alias("o_start"))
    meets = (F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("_h") == F.col("o_h")) & (F.col("bin") == F.col("o_bin"))
             & (F.abs(F.col("start") - F.col("o_start")) <= reach) & _complements(F.col("role"), F.col("o_role")))
    return (weak.join(other, meets, "left_semi").groupBy("doc_id", "_h")
            .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("links")))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, _h and ``spans`` (start, rank of the kind, kind, stop) in order, for every row of documents."""
    found = saved(parts(docs), "parts")
    links = linked(found, reach).select(F.col("doc_id").alias("l_doc"), F.col("_h").alias("l_h"), "links")
    rank = lambda kind: F.array_position(F.array(*map(F.lit, ORDER)), kind)
    span = lambda p: F.struct(p["start"].alias("start"), rank(p["kind"]).alias("rank"), p["kind"].alias("kind"),
                              p["stop"].alias("stop"))
    base = F.transform(F.filter("parts", lambda p: p["strong"]), span)
    more = F.transform(F.coalesce("links", F.array().cast("array<struct<kind:string,start:int,stop:int>>")), span)
    return (found.join(links, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("_h") == F.col("l_h")), "left")
            .select("doc_id", "_h", F.array_sort(F.concat(base, more)).alias("spans")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """A text with each of its spans (ordered by start, maybe overlapping) replaced by its kind in brackets.

    Text and spans are taken in blocks, so that neither is gone through from its beginning for each span.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    last = F.floor(F.greatest(F.size(spans) - 1, F.lit(0)) / F.lit(_BLOCK)).cast("int")
    some = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<string>")

    def state(at: Column, out: Column, of: Column) -> Column:
        return F.struct(at.alias("at"), out.alias("out"), of.alias("of"))

    def between(of: Column, a: Column, n: Column) -> Column:
        first = F.floor(a / F.lit(_BLOCK)).cast("int")
        near = F.slice(of, first + 1, F.floor(n / F.lit(_BLOCK)).cast("int") + 2)
        return F.substring(F.array_join(near, ""), a - first * _BLOCK + 1, n)

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(between(acc["of"], acc["at"], s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return state(F.greatest(acc["at"], s["stop"]), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]), acc["of"])

    def block(acc: Column, part: Column) -> Column:
        return F.aggregate(part, state(acc["at"], none, acc["of"]), step, lambda done: state(
            done["at"], F.concat(acc["out"], F.array(F.array_join(done["out"], ""))), done["of"]))

    return F.aggregate(some, state(F.lit(0), none, blocks), block, lambda acc: F.concat(
        F.array_join(acc["out"], ""), between(acc["of"], acc["at"], F.greatest(F.length(text) - acc["at"], F.lit(0)))))
