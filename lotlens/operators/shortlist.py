"""Lexical shortlist: every lot against every curated bucket.

Up to SCANNED_SEEDS seeds each bucket becomes one literal pattern evaluated
inside the scan, and nothing is shuffled. Longer lists meet the lots through the
words that hold their rarest token, so that a lot is tried against few seeds
however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns, text, vocab
from ..sources.config import Bucket, Interest
from .common import keep, share, written_once
from .words import texts_with

#: Up to so many seeds are patterns of the scan.
SCANNED_SEEDS = 4_000
HAYSTACK = ("title", "model", "size", "notes", "category")


def haystack(columns: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HAYSTACK if c in columns]
    return text.seed_normalise(F.concat_ws(" ", *parts))


def crumb_segments(category: Column) -> Column:
    return F.transform(F.split(F.coalesce(category, F.lit("")), vocab.CRUMB),
                       lambda s: text.seed_normalise(text.strip(s)))


def _reason(rule: Bucket, body: Column, crumbs: Column, condition: Column, gate: bool) -> Column:
    """What made the lot a candidate, or NULL. A veto comes first; a missing
    condition is never gated out; a seed is reported before a category."""
    found = F.lit(None).cast("string")
    pattern = patterns.shortlist_pattern(list(rule.seeds))
    if pattern:
        found = F.regexp_substr(body, F.lit(pattern))
    for prefix in rule.categories:
        segments = [patterns.fold_hyphens(s.strip()) for s in prefix.split(vocab.CRUMB)]
        inside = F.slice(crumbs, 1, len(segments)) == F.array(*[F.lit(s) for s in segments])
        found = F.coalesce(found, F.when(inside, F.lit(vocab.CRUMB.join(segments))))
    admitted = F.lit(True)
    if gate and rule.condition_in:
        admitted = condition.isNull() | condition.isin(*rule.condition_in)
    veto = patterns.shortlist_pattern(list(rule.exclude))
    if veto:
        admitted = admitted & ~body.rlike(veto)
    return F.when(admitted, found)


HITS = "array<struct<bucket:string,reason:string>>"


def _hits(names: Sequence[str], columns: Sequence[str]) -> Column:
    """The rules with a reason, in rule order."""
    found = [F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("bucket"), F.col(c).alias("reason")))
             for n, c in zip(names, columns)]
    return F.array_compact(F.array(*found)) if found else F.array().cast(HITS)


def _configured(buckets: Sequence[Bucket], interests: Sequence[Interest]) -> dict[str, list[Bucket]]:
    pseudo = [i.as_rule() for i in interests]
    return {"cand": [b for b in buckets if b.configured], "profile": [r for r in pseudo if r.configured]}


def shortlist_lots(lots: DataFrame, buckets: Sequence[Bucket], interests: Sequence[Interest] = (),
                   gate: bool = True) -> DataFrame:
    """Every lot with ``cand`` (buckets hit) and ``profile`` (interests hit)."""
    rules = _configured(buckets, interests)
    seeds = sum(len(r.seeds) + len(r.exclude) for listed in rules.values() for r in listed)
    return (shortlist_scanned if seeds <= SCANNED_SEEDS else shortlist_by_words)(lots, buckets, interests, gate)


def shortlist_scanned(lots: DataFrame, buckets: Sequence[Bucket], interests: Sequence[Interest] = (), gate: bool = True) -> DataFrame:
    category = F.col("category") if "category" in lots.columns else F.lit("")
    rules = _configured(buckets, interests)
    condition = F.col("condition") if "condition" in lots.columns else F.lit(None).cast("string")
    prepared = lots.select("*", haystack(lots.columns).alias("_body"), crumb_segments(category).alias("_crumbs"))
    # One column per rule, so that each pattern runs in generated code exactly once.
    reasons = prepared.select(*lots.columns, *[
        _reason(r, F.col("_body"), F.col("_crumbs"), condition, gate).alias(f"_{kind}{i}")
        for kind, listed in rules.items() for i, r in enumerate(listed)])
    return reasons.select(*lots.columns, *[
        _hits([r.name for r in listed], [f"_{kind}{i}" for i in range(len(listed))]).alias(kind)
        for kind, listed in rules.items()])


def _rows_of_rules(rules: dict[str, list[Bucket]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(kind, rule, veto, seed, pattern), (kind, rule, path, place), and (kind, rule, name, conditions) of all rules."""
    seeds, paths, names = [], [], []
    for kind, listed in rules.items():
        for i, r in enumerate(listed):
            names.append((kind, i, r.name, list(r.condition_in)))
            for veto, some in ((False, r.seeds), (True, r.exclude)):
                for seed in dict.fromkeys(s for s in some if s and s.strip()):
                    seeds.append((kind, i, veto, patterns.fold_hyphens(seed.strip()), patterns.shortlist_pattern([seed])))
            for place, prefix in enumerate(r.categories):
                paths.append((kind, i, vocab.CRUMB.join(patterns.fold_hyphens(s.strip()) for s in prefix.split(vocab.CRUMB)), place))
    return seeds, paths, names


def shortlist_by_words(lots: DataFrame, buckets: Sequence[Bucket], interests: Sequence[Interest] = (), gate: bool = True) -> DataFrame:
    """The same for any number of seeds; rules are tables here.

    What a pattern finds first is the leftmost seed, of several there the longest; so each seed's first place is found by
    itself, and the least (place, longest) of a rule's seeds is its reason.
    """
    spark = lots.sparkSession
    category = F.col("category") if "category" in lots.columns else F.lit("")
    condition = F.col("condition") if "condition" in lots.columns else F.lit(None).cast("string")
    seeds, paths, names = _rows_of_rules(_configured(buckets, interests))
    table = spark.createDataFrame(names, "kind string, rule int, bucket string, conditions array<string>")
    held = written_once(lots.select(F.struct(*lots.columns).alias("_r"), haystack(lots.columns).alias("_body"),
                                    crumb_segments(category).alias("_crumbs"), condition.alias("_condition"))
                        .withColumn("_row", F.monotonically_increasing_id()), "lots")
    rules = spark.createDataFrame(seeds, "kind string, rule int, veto boolean, seed string, pattern string")
    distinct = list(dict.fromkeys((s, p) for _, _, _, s, p in seeds))
    tried = texts_with(held.select("_row", "_body"), [(p, s.split(), p) for s, p in distinct])
    placed = (tried.withColumn("at", F.regexp_instr("_body", F.col("pattern"))).where("at > 0")
              .select("_row", "pattern", "at").join(rules, "pattern"))
    by_seed = placed.groupBy("_row", "kind", "rule").agg(
        F.bool_or("veto").alias("veto"),
        F.min_by("seed", F.when(~F.col("veto"), F.struct("at", (-F.length("seed")).alias("n"), "seed"))).alias("seed"))
    # A lot has as many prefixes as its path is long.
    inside = held.select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_crumbs"), F.lit(1))), lambda n: F.array_join(
        F.slice("_crumbs", F.lit(1), n), vocab.CRUMB))).alias("path"))
    under = (inside.join(spark.createDataFrame(paths, "kind string, rule int, path string, place int"), "path")
             .groupBy("_row", "kind", "rule").agg(F.min_by("path", "place").alias("path")))
    met = by_seed.join(under, ["_row", "kind", "rule"], "full").withColumn("reason", F.coalesce("seed", "path"))
    met = met.where(F.col("reason").isNotNull() & ~F.coalesce("veto", F.lit(False))).join(table, ["kind", "rule"])
    if gate:
        mine = held.select("_row", "_condition")
        open_to = F.col("_condition").isNull() | (F.size("conditions") == 0) | F.array_contains("conditions", F.col("_condition"))
        met = met.join(mine, "_row").where(open_to)
    entry = F.struct("rule", "bucket", "reason")
    list_of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))),
                                    lambda e: F.struct(e["bucket"].alias("bucket"), e["reason"].alias("reason"))).alias(k)
    # As many entries as there are rules, at most.
    found = met.groupBy("_row").agg(list_of("cand"), list_of("profile"))
    none = F.array().cast(HITS)
    return (held.select("_row", "_r").join(found, "_row", "left")
            .select("_r.*", F.coalesce("cand", none).alias("cand"), F.coalesce("profile", none).alias("profile")))


def admitted(hits: str, condition: Column, rules: Sequence[Bucket]) -> Column:
    """Of hits found without the condition gate those that pass it; the rules are not matched again."""
    gated = {r.name: r.condition_in for r in rules if r.condition_in}
    if not gated:
        return F.col(hits)
    allowed = F.create_map(*[F.lit(x) for n, v in gated.items() for x in (n, ",".join(sorted(v)))])
    # A condition holds no comma, so membership is a search in the list with commas around.
    wrap = lambda c: F.concat(F.lit(","), c, F.lit(","))
    return F.filter(hits, lambda h: condition.isNull() | F.try_element_at(allowed, h["bucket"]).isNull()
                    | F.contains(wrap(F.try_element_at(allowed, h["bucket"])), wrap(condition)))


def _candidates(shortlisted: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    # Exploding a derived array rather than the column itself: for a bare column the
    # optimizer adds a filter on its size, which would match every pattern twice.
    entries = F.transform("cand", lambda c: F.struct(c["bucket"].alias("bucket"), c["reason"].alias("reason")))
    return shortlisted.select(*scope, "lot_number", F.explode(entries).alias("_c")).select(
        *scope, "lot_number", "_c.bucket", "_c.reason")


def bucket_rows(shortlisted: DataFrame, *columns: str) -> DataFrame:
    """One row per (lot, bucket) with the given columns of the lot."""
    names = F.transform("cand", lambda c: c["bucket"])
    return shortlisted.select(*columns, F.explode(names).alias("bucket"))


def bucket_sizes(shortlisted: DataFrame, top: int = 3, scope: Sequence[str] = ()) -> DataFrame:
    """Lots per bucket, their share of all lots of the scope, and the most productive seeds."""
    counted = (_candidates(shortlisted, scope).groupBy(*scope, "bucket", "reason").agg(F.count("*").alias("n")))
    order = W.partitionBy(*scope, "bucket").orderBy(F.desc("n"), "reason")
    ranked = counted.withColumn("rn", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "reason", "n"))))
    sizes = ranked.groupBy(*scope, "bucket").agg(F.sum("n").alias("lots"), best.alias("top_seeds"))
    if scope:
        total = shortlisted.groupBy(*scope).agg(F.count("*").alias("_total"))
        sizes = sizes.join(total, list(scope))
    else:
        sizes = sizes.withColumn("_total", shortlisted.agg(F.count("*")).scalar())
    return sizes.withColumn("share", F.round(F.col("lots") / F.col("_total"), 6)).drop("_total")


def top_seeds(shortlisted: DataFrame, top: int = 3) -> DataFrame:
    return (bucket_sizes(shortlisted, top).select("bucket", F.explode("top_seeds").alias("s"))
            .select("bucket", F.col("s.rn").alias("rank"), F.col("s.reason").alias("seed"), F.col("s.n").alias("lots")))


def with_primary(shortlisted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate rows with their rarest bucket; rows only an interest hit come first.

    ``sizes`` has one row per configured bucket, so it travels as one array.
    """
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "lots")))).scalar()
    rows = (keep(shortlisted, (F.size("cand") > 0) | (F.size("profile") > 0))
            .withColumn("_sizes", table))
    rarest = F.array_min(F.transform("cand", lambda c: F.struct(
        F.coalesce(F.try_element_at("_sizes", c["bucket"]), F.lit(0)).alias("size"), c["bucket"].alias("bucket"))))
    return (rows.withColumn("_r", rarest)
            .withColumn("primary_size", F.coalesce("_r.size", F.lit(0)).cast("bigint"))
            .withColumn("primary_bucket", F.coalesce("_r.bucket", F.lit("~profile only")))
            .drop("_r", "_sizes"))


def candidate_order(primary: DataFrame) -> DataFrame:
    """Where each bucket's run starts when rows are ordered by (size, bucket, lot).

    Offsets are prefix sums over the per-bucket counts; no row is sorted.
    """
    runs = primary.groupBy("primary_size", "primary_bucket").agg(F.count("*").alias("n"))
    before = W.orderBy("primary_size", "primary_bucket").rowsBetween(W.unboundedPreceding, -1)
    return runs.select("primary_bucket", "primary_size",
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_row"),
                       F.col("n").alias("rows"))


def sweep_sample(shortlisted: DataFrame, n: int = vocab.SWEEP_ROWS, seed: str = vocab.SWEEP_SEED) -> DataFrame:
    """A repeatable sample of lots nothing matched, for quality checks."""
    rest = keep(shortlisted, (F.size("cand") == 0) & (F.size("profile") == 0))
    return rest.orderBy(F.md5(F.concat(F.lit(seed), F.col("lot_number"))), "lot_number").limit(n)


# --- backtest and audit ---------------------------------------------------------------

def _renamed(bucket: Column, buckets: Sequence[Bucket]) -> Column:
    pairs = [F.lit(x) for b in buckets for a in b.aliases for x in (a, b.name)]
    if not pairs:
        return bucket
    return F.coalesce(F.try_element_at(F.create_map(*pairs), bucket), bucket)


def scored_labels(labels: DataFrame, lots: DataFrame, buckets: Sequence[Bucket], gate: bool = True,
                  scope: Sequence[str] = ()) -> DataFrame:
    """Labels with the names the shortlist gives their lot; ``known`` is false when
    the lot is not in the table."""
    found = shortlist_lots(lots, buckets, gate=gate).select(
        *scope, "lot_number", F.transform("cand", lambda c: c["bucket"]).alias("cand_names"),
        F.lit(True).alias("known"))
    return labels.join(found, [*scope, "lot_number"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def backtest_buckets(scored: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    """Pair recall per bucket, old bucket names mapped forward."""
    pairs = (scored.where("known").select(*scope, "cand_names", F.explode("buckets").alias("_b"))
             .withColumn("bucket", _renamed(F.col("_b"), buckets)))
    hit = F.array_contains("cand_names", F.col("bucket"))
    return (pairs.groupBy(*scope, "bucket").agg(F.count_if(hit).alias("hit"), F.count("*").alias("total"))
            .withColumn("recall", F.round(F.col("hit") / F.col("total"), 6))
            .withColumn("weak", (F.col("total") >= 10) & (F.col("hit") / F.col("total") < 0.9)))


def backtest_summary(scored: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = ()) -> DataFrame:
    """Overall pair recall, lot recall, and the share of labels without a lot."""
    names = F.transform("buckets", lambda b: _renamed(b, buckets))
    pair_hits = F.size(F.filter(names, lambda b: F.array_contains("cand_names", b)))
    known = F.col("known")
    flagged = known & (F.size("buckets") > 0)
    sums = scored.groupBy(*scope).agg(
        F.count("*").alias("labels"),
        F.count_if(~known).alias("unmatched"),
        F.coalesce(F.sum(F.when(known, F.size("buckets"))), F.lit(0)).cast("bigint").alias("pairs"),
        F.coalesce(F.sum(F.when(flagged, pair_hits)), F.lit(0)).cast("bigint").alias("pair_hits"),
        F.count_if(flagged).alias("flagged_lots"),
        F.count_if(flagged & (F.size("cand_names") > 0)).alias("reached_lots"))
    ratio = lambda a, b: F.round(share(F.col(a), F.col(b)), 6)
    return (sums.withColumn("pair_recall", ratio("pair_hits", "pairs"))
            .withColumn("lot_recall", ratio("reached_lots", "flagged_lots"))
            .withColumn("unmatched_share", ratio("unmatched", "labels")))


def audit_shown_kept(shortlisted: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per bucket: lots shown, labels kept, labels assigned outside the shortlist."""
    shown = _candidates(shortlisted).groupBy("bucket").agg(F.count("*").alias("shown"))
    names = shortlisted.select(*scope, "lot_number",
                               F.transform("cand", lambda c: c["bucket"]).alias("_names"))
    accepted = (labels.where(F.size("buckets") > 0).join(names, [*scope, "lot_number"], "left")
                .select(F.explode("buckets").alias("bucket"), "_names"))
    inside = F.coalesce(F.array_contains("_names", F.col("bucket")), F.lit(False))
    kept = accepted.groupBy("bucket").agg(F.count("*").alias("kept"), F.count_if(~inside).alias("outside"))
    s, k = F.coalesce("shown", F.lit(0)), F.coalesce("kept", F.lit(0))
    return shown.join(kept, "bucket", "full").select(
        "bucket", s.alias("shown"), k.alias("kept"), F.coalesce("outside", F.lit(0)).alias("outside"),
        F.round(share(k, s), 6).alias("rate"),
        F.when((s >= 20) & (k == 0), "refused").when((s > 0) & (k / s > 0.95), "shortlist decides").alias("note"))


def audit_picks_no_bucket(labels: DataFrame, top: int = 15) -> DataFrame:
    """Tags of personal picks that carry no bucket."""
    picks = labels.where((F.col("personal_match") == True) & (F.size("buckets") == 0))  # noqa: E712
    return (picks.select(F.explode("personal_tags").alias("tag")).groupBy("tag")
            .agg(F.count("*").alias("picks")).orderBy(F.desc("picks"), "tag").limit(top))


def audit_seed_lift(lots: DataFrame, labels: DataFrame, buckets: Sequence[Bucket], scope: Sequence[str] = (),
                    top: int | None = 25, min_lots: int = 8, min_len: int = 4, min_lift: float = 0.75) -> DataFrame:
    """One- and two-word terms common in kept titles and rare elsewhere."""
    kept = (labels.where(F.size("buckets") > 0).select(*scope, "lot_number").distinct()
            .withColumn("_kept", F.lit(True)))
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    df = (lots.select(*scope, "lot_number", words.alias("_w")).join(kept, [*scope, "lot_number"], "left"))
    n = F.size("_w")
    pairs = F.when(n > 1, F.transform(
        F.arrays_zip(F.slice("_w", F.lit(1), n - 1).alias("a"), F.slice("_w", F.lit(2), n - 1).alias("b")),
        lambda p: F.concat_ws(" ", p["a"], p["b"]))).otherwise(F.array().cast("array<string>"))
    terms = F.explode(F.array_distinct(F.concat("_w", pairs)))
    known = sorted({s.strip().lower() for b in buckets for s in b.seeds if s.strip()})
    counted = (df.select(terms.alias("term"), "_kept")
               .where((F.length("term") >= min_len) & ~F.col("term").isin(known))
               .groupBy("term").agg(F.count("_kept").alias("kept"), F.count("*").alias("total")))
    lift = F.col("kept") / F.col("total")
    out = (counted.where((F.col("kept") >= min_lots) & (lift > min_lift))
           .select("term", "kept", F.round(lift, 6).alias("lift")))
    return out if top is None else out.orderBy(F.desc("lift"), F.desc("kept"), F.desc("term")).limit(top)
