"""Checks that return their violations and stop a write.

A gate is a table (scope..., check, problem, n, fatal); require() raises when it
holds a fatal row. ``scope`` names the columns a lot number is unique in (the
auction, the week): shares, limits and comparisons hold for each scope by itself,
so that one bad auction cannot hide in the average of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..sources.config import Bucket


class GateError(RuntimeError):
    """A check found fatal violations; nothing was written."""


def require(violations: DataFrame, name: str) -> None:
    bad = violations.where("fatal").orderBy(F.desc("n"), "problem").head(5)
    if bad:
        raise GateError(f"{name}: " + "; ".join(f"{r['check']}: {r['problem']} ({r['n']})" for r in bad))


def _report(df: DataFrame, rules: Sequence[tuple[str, Column, Column, Column, bool]],
            scope: Sequence[str] = ()) -> DataFrame:
    """Turn a row of measures for each scope into rows for the rules that fail:
    (check, failed?, problem text, how many, fatal)."""
    entries = F.array(*[
        F.when(failed, F.struct(F.lit(check).alias("check"), problem.alias("problem"),
                                n.cast("bigint").alias("n"), F.lit(fatal).alias("fatal")))
        for check, failed, problem, n, fatal in rules])
    return df.select(*scope, F.explode(F.array_compact(entries)).alias("v")).select(*scope, "v.*")


def gate_closed(lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every lot must be CLOSED before prices are taken from it."""
    status = F.upper(text.strip(F.coalesce("status", F.lit(""))))
    return (lots.select(*scope, status.alias("problem")).where(F.col("problem") != "CLOSED").groupBy(*scope, "problem")
            .agg(F.count("*").alias("n"))
            .select(*scope, F.lit("closed").alias("check"), "problem", "n", F.lit(True).alias("fatal")))


def lot_violations(lots: DataFrame) -> Column:
    """Names of the output columns a row breaks the schema in."""
    text_fields = ("day", "lot_number", "title", "description", "lot_url", "category", "subcategory",
                   "thumb_url", "image_url")
    checks = [(c, F.col(c).isNull()) for c in text_fields if c in lots.columns]
    checks += [(c, F.col(c).isNull() | F.exists(c, lambda v: v.isNull()))
               for c in ("buckets", "category_path") if c in lots.columns]
    checks += [("is_flagged", F.col("is_flagged").isNull()),
               ("confidence", F.col("confidence").isNull() | ~F.col("confidence").isin(*vocab.CONFIDENCES))]
    if "resale_confidence" in lots.columns:
        checks.append(("resale_confidence", ~F.col("resale_confidence").isin(*vocab.CONFIDENCES)))
    if "resale_outlook" in lots.columns:
        checks.append(("resale_outlook", ~F.col("resale_outlook").isin(*vocab.OUTLOOKS)))
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]))


def lot_schema_rows(lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The rows that do not conform, with the fields they break, in vocabulary order."""
    return (lots.select(*scope, "lot_number", lot_violations(lots).alias("fields"))
            .where(F.size("fields") > 0))


def gate_lot_schema(lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows that do not conform, counted per offending field."""
    return (lots.select(*scope, F.explode(lot_violations(lots)).alias("problem")).groupBy(*scope, "problem")
            .agg(F.count("*").alias("n"))
            .select(*scope, F.lit("lot schema").alias("check"), "problem", "n", F.lit(True).alias("fatal")))


def gate_slim(slim: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Required fields on every row, a condition on at least half."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c) != "", F.lit(False)))
    m = slim.groupBy(*scope).agg(F.count("*").alias("total"), *[filled(c).alias(c) for c in ("lot_number", "title", "category", "condition")])
    missing = lambda c: F.col("total") - F.col(c)
    return _report(m, [
        *[("required field", missing(c) > 0, F.lit(c), missing(c), True) for c in ("lot_number", "title", "category")],
        ("condition coverage", F.col("condition") < 0.5 * F.col("total"), F.lit("condition"), missing("condition"), True)], scope)


def gate_prefilter(sizes: DataFrame, shortlisted: DataFrame, buckets: Sequence[Bucket],
                   max_share: float = vocab.MAX_BUCKET_SHARE, max_rows: int = vocab.MAX_SHORTLIST_ROWS,
                   scope: Sequence[str] = ()) -> DataFrame:
    """A bucket or a shortlist that grew out of hand, stale gates, empty buckets.

    ``max_rows`` is what one scope (a week of one auction) may shortlist.
    """
    wide = (sizes.where(F.col("share") > max_share)
            .select(*scope, F.lit("bucket share").alias("check"), F.col("bucket").alias("problem"),
                    F.col("lots").alias("n"), F.lit(True).alias("fatal")))
    rows = shortlisted.groupBy(*scope).agg(F.count_if((F.size("cand") > 0) | (F.size("profile") > 0)).alias("rows"))
    over = _report(rows, [("rows", F.col("rows") > max_rows, F.lit("shortlist"), F.col("rows"), True)], scope)
    names = F.array(*[F.lit(b.name) for b in buckets if b.configured]).cast("array<string>")
    configured = rows.select(*scope, F.explode(names).alias("problem"))
    empty = (configured.join(sizes.select(*scope, F.col("bucket").alias("problem")), [*scope, "problem"], "left_anti")
             .select(*scope, F.lit("empty bucket").alias("check"), "problem", F.lit(0).cast("bigint").alias("n"),
                     F.lit(False).alias("fatal")))
    stale = [(f"{b.name}: {c}",) for b in buckets for c in b.condition_in if c not in vocab.CONDITIONS]
    keys = [F.lit(None).cast(t).alias(c) for c, t in sizes.dtypes if c in scope]  # a rule is stale everywhere
    stale = sizes.sparkSession.createDataFrame(stale, "problem string").select(
        *keys, F.lit("stale condition").alias("check"), "problem", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("fatal"))
    return wide.unionByName(over).unionByName(empty).unionByName(stale)


FORBIDDEN_KEYS = ("label_category", "label_subcategory", "category", "subcategory", "reasoning", "confidence")
REQUIRED_KEYS = ("lot_number", "is_flagged", "buckets", "personal_match")


def gate_coverage(chunks: DataFrame, products: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Chunks must cover every product (``rep_lot``) once: a chunk that is missing,
    or was cut anew after the run, leaves some out."""
    keys = [*scope, "lot_number"]
    cut = chunks.groupBy(*keys).agg(F.count("*").alias("_n"))
    all_reps = products.select(*scope, F.col("rep_lot").alias("lot_number")).distinct().withColumn("_in", F.lit(True))
    m = cut.join(all_reps, keys, "full").groupBy(*scope).agg(
        F.count_if(F.col("_n").isNull()).alias("absent"), F.count_if(F.col("_in").isNull()).alias("foreign"),
        F.count_if(F.col("_n") > 1).alias("twice"))
    rule = lambda c, text: ("coverage", F.col(c) > 0, F.lit(text), F.col(c), True)
    return _report(m, [rule("absent", "products in no chunk"), rule("foreign", "chunk rows of no product"),
                       rule("twice", "products in two chunks")], scope)


def gate_responses(chunks: DataFrame, responses: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Reconcile returned label rows with the chunks they answer, for each scope.

    ``chunks``: chunk, lot_number, is_last. ``responses``: chunk, pos, lot_number,
    is_flagged, buckets, personal_match, chunk_complete (end marker) and ``keys``,
    the names present in the returned object.
    """
    at = [*scope, "chunk"]
    last = chunks.groupBy(*at).agg(F.max(F.when(F.col("is_last"), F.col("lot_number"))).alias("last_lot"))
    marker = F.col("chunk_complete").isNotNull()
    shape = (responses.groupBy(*at)
             .agg(F.count("*").alias("rows"), F.max("pos").alias("end"),
                  F.max(F.when(marker, F.col("pos"))).alias("marker_pos"),
                  F.max_by("chunk_complete", F.when(marker, F.col("pos"))).alias("marker")))
    shape = last.join(shape, at, "left")
    one = F.lit(1)
    whole = [
        ("empty", F.col("rows").isNull(), one),
        ("no end marker", F.col("rows").isNotNull() & F.col("marker_pos").isNull(), one),
        ("end marker not last", F.col("marker_pos") < F.col("end"), one),
        ("wrong end marker", F.col("marker") != F.col("last_lot"), one)]
    shape_rows = shape.select(*at, F.explode(F.array_compact(F.array(*[
        F.when(failed, F.struct(F.lit(p).alias("problem"), n.cast("bigint").alias("n"))) for p, failed, n in whole]))).alias("v")
    ).select(*at, "v.*")

    rows = responses.where(~marker)
    forbidden = F.arrays_overlap("keys", F.array(*[F.lit(k) for k in FORBIDDEN_KEYS]))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.col("keys"))) > 0
    broken = F.coalesce(F.col("is_flagged"), F.lit(False)) != (F.size(F.coalesce(
        "buckets", F.array().cast("array<string>"))) > 0)
    known = chunks.select(*at, "lot_number").distinct().withColumn("_known", F.lit(True))
    judged = rows.join(known, [*at, "lot_number"], "left")
    verdict = (F.when(forbidden, "forbidden key").when(missing, "missing key")
               .when(F.col("_known").isNull(), "foreign lot").otherwise("ok"))
    judged = judged.withColumn("problem", verdict).withColumn("_broken", broken)
    single = (judged.where("problem <> 'ok'").groupBy(*at, "problem").agg(F.count("*").alias("n")))
    # The first acceptable row of a lot is its answer and every later row a repeat;
    # a broken row before it is only broken.
    per_lot = (judged.where("problem = 'ok'").groupBy(*at, "lot_number")
               .agg(F.min(F.when(~F.col("_broken"), F.col("pos"))).alias("first_good")))
    seen = judged.where("problem = 'ok'").join(per_lot.select(*at, "lot_number", "first_good"), [*at, "lot_number"])
    repeat = F.col("pos") > F.col("first_good")
    ordered = seen.select(*at, F.when(repeat, "returned twice").when(F.col("_broken"), "flag without bucket").alias("problem"))
    ordered = ordered.where("problem is not null").groupBy(*at, "problem").agg(F.count("*").alias("n"))
    good = per_lot.where("first_good is not null").select(*at, "lot_number")
    opened = good.groupBy(*scope, "lot_number").agg(F.min("chunk").alias("_first"))
    twice = (good.join(opened, [*scope, "lot_number"]).where(F.col("chunk") > F.col("_first"))
             .groupBy(*at).agg(F.count("*").alias("n")).withColumn("problem", F.lit("judged in two chunks")))
    out = shape_rows.unionByName(single).unionByName(ordered).unionByName(twice)
    return out.select(*at, F.lit("responses").alias("check"), "problem", "n", F.lit(True).alias("fatal"))


def gate_fanout(products: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Copies of all products must add up to the lots."""
    both = products.select(*scope, F.col("qty").alias("_c"), F.lit(0).alias("_l")).unionByName(
        lots.select(*scope, F.lit(0).alias("_c"), F.lit(1).alias("_l")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    m = both.groupBy(*scope).agg(total("_c").alias("covered"), total("_l").alias("lots"))
    return _report(m, [("fan-out", F.col("covered") != F.col("lots"), F.lit("lots not covered once"),
                        F.abs(F.col("lots") - F.col("covered")), True)], scope)


def label_measures(labels: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    """All label measures in one pass, a row for each scope."""
    names = F.array(*[F.lit(b.name) for b in buckets])
    flagged = F.size("buckets") > 0
    subtype = F.coalesce(F.col("subtype") != "", F.lit(False))
    pick = F.coalesce(F.col("personal_match"), F.lit(False))
    explained = F.coalesce(F.col("personal_reasoning") != "", F.lit(False))
    older = F.col("has_label_category") if "has_label_category" in labels.columns else F.lit(False)
    return labels.groupBy(*scope).agg(
        F.count("*").alias("rows"), F.count_if(older).alias("older_shape"),
        F.coalesce(F.sum(F.size(F.filter("buckets", lambda b: ~F.array_contains(names, b)))), F.lit(0))
        .cast("bigint").alias("unknown_buckets"),
        F.count_if(F.coalesce("is_flagged", F.lit(False)) != flagged).alias("broken_flag"),
        F.count_if(flagged).alias("flagged"), F.count_if(flagged & subtype).alias("with_subtype"),
        F.count_if(pick).alias("picks"), F.count_if(pick & explained).alias("explained"))


def gate_labels(labels: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    c = F.col
    short = lambda part, whole, pct: (c(whole) > 0) & (100 * c(part) / c(whole) < pct)
    return _report(label_measures(labels, buckets, scope), [
        ("label shape", c("older_shape") > 0, F.lit("older label shape"), c("older_shape"), True),
        ("buckets", c("unknown_buckets") > 0, F.lit("unknown buckets"), c("unknown_buckets"), True),
        ("flag", c("broken_flag") > 0, F.lit("flag without bucket"), c("broken_flag"), True),
        ("subtypes", short("with_subtype", "flagged", vocab.SUBTYPE_MIN_PCT), F.lit("subtype missing"),
         c("flagged") - c("with_subtype"), True),
        ("reasons", short("explained", "picks", vocab.REASONING_MIN_PCT), F.lit("reason missing"),
         c("picks") - c("explained"), True)], scope)


def vocabulary_strays(labels: DataFrame, buckets: Sequence[Bucket], tags: Sequence[str]) -> DataFrame:
    """Buckets, subtypes and tags outside the declared vocabulary, with counts."""
    declared = {"bucket": [b.name for b in buckets],
                "subtype": sorted({" ".join(s.split()).lower() for b in buckets for s in b.subtypes}),
                "tag": sorted({t.lower() for t in tags})}
    none = F.array().cast("array<string>")
    tag_list = F.transform(F.coalesce("personal_tags", none), F.lower)
    used = F.array_compact(F.concat(
        F.transform("buckets", lambda b: F.struct(F.lit("bucket").alias("kind"), b.alias("value"))),
        F.array(F.when((F.size("buckets") > 0) & F.col("subtype").isNotNull(), F.struct(
            F.lit("subtype").alias("kind"), text.normalise_subtype(F.col("subtype")).alias("value")))),
        F.when(F.coalesce("personal_match", F.lit(False)), F.transform(
            tag_list, lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>"))))
    counted = (labels.select(F.explode(used).alias("u")).select("u.*").where("value is not null")
               .groupBy("kind", "value").agg(F.count("*").alias("n")))
    known = F.lit(False)
    for kind, names in declared.items():
        known = known | ((F.col("kind") == kind) & F.col("value").isin(names))
    return counted.where(~known)


def lot_set_sha(lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Order-independent fingerprint of a lot set.

    Per-lot digests are added up, so it is one partial aggregation and no task
    ever holds the list of lots.
    """
    digest = F.sha2(F.coalesce(F.col("lot_number").cast("string"), F.lit("")), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = lots.groupBy(*scope).agg(F.count("*").alias("lots"), part(1).alias("_a"), part(16).alias("_b"))
    joined = F.concat_ws(":", F.col("lots").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return sums.select(*scope, "lots", F.substring(F.sha2(joined, 256), 1, 16).alias("lot_set_sha"))


def lot_set_compare(rows: DataFrame, lots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows against the lot set, per scope: unknown, absent and repeated lots."""
    keys = [*scope, "lot_number"]
    a = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    b = lots.select(*keys).distinct().withColumn("_in", F.lit(True))
    both = a.join(b, keys, "full")
    return both.groupBy(*scope).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("_n").alias("distinct_lots"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("_in").isNull()).alias("unknown"),
        F.count_if(F.col("_n").isNull()).alias("absent"))


def gate_lot_sets(rows: DataFrame, lots: DataFrame, required: Sequence[str], complete: bool,
                  scope: Sequence[str] = ()) -> DataFrame:
    """A label or valuation table against the current lots of each scope. ``complete``
    demands a row for every lot."""
    missing = [c for c in required if c not in rows.columns]
    c = F.col
    report = _report(lot_set_compare(rows, lots, scope), [
        *[("required field", F.lit(True), F.lit(m), F.lit(1), True) for m in missing],
        ("duplicates", c("duplicates") > 0, F.lit("repeated lots"), c("duplicates"), True),
        ("unknown", c("unknown") > 0, F.lit("lots not in this set"), c("unknown"), True),
        ("absent", c("absent") > 0, F.lit("lots without a row"), c("absent"), complete)], scope)
    if not complete:
        return report
    # One row for each scope and side: the fingerprints agree, or the sets differ.
    prints = (lot_set_sha(rows, scope).withColumn("_side", F.lit(0))
              .unionByName(lot_set_sha(lots, scope).withColumn("_side", F.lit(1))))
    same = prints.groupBy(*scope).agg(
        (F.count_distinct("lot_set_sha") == 1).alias("_one"), (F.count("*") == 2).alias("_both"),
        F.coalesce(F.max(F.when(c("_side") == 0, c("lots"))), F.lit(0)).alias("n"))
    return report.unionByName(_report(same, [
        ("fingerprint", ~(c("_one") & c("_both")), F.lit("another lot set"), c("n"), True)], scope))


def gate_stale_pairing(summary: DataFrame, limit: float = 0.01, scope: Sequence[str] = ()) -> DataFrame:
    """Refuse a backtest whose labels do not belong to these lots."""
    return _report(summary, [("pairing", F.col("unmatched_share") > limit, F.lit("labels of another lot set"),
                              F.col("unmatched"), True)], scope)


def gate_bundle(fidelity: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return _report(fidelity, [
        ("rows", c("lots") == 0, F.lit("no lots"), F.lit(0), True),
        ("title", c("titled") < c("lots"), F.lit("lots without a title"), c("lots") - c("titled"), True),
        ("image", c("imaged") < 0.95 * c("lots"), F.lit("image coverage below 95%"), c("lots") - c("imaged"), False)], scope)
