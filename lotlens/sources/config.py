"""Curated configuration: buckets, interests and the search-term legend.

These are short hand-written lists. They are read on the driver, checked there,
and reach Spark either as literals inside expressions or as small tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab
from ..functions.patterns import fold_hyphens


@dataclass(frozen=True)
class Bucket:
    name: str
    group: str = vocab.UNGROUPED
    seeds: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    condition_in: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    seed_exempt: tuple[str, ...] = ()

    @property
    def configured(self) -> bool:
        return bool(self.seeds or self.categories)


@dataclass(frozen=True)
class Interest:
    name: str
    buckets: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    condition_in: tuple[str, ...] = ()

    def as_rule(self) -> Bucket:
        return Bucket(self.name, seeds=self.seeds, categories=self.categories,
                      exclude=self.exclude, condition_in=self.condition_in)


@dataclass(frozen=True)
class TermGroup:
    name: str
    terms: tuple[str, ...] = field(default=())


def _build(kind, entry: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(map(str, v)) if isinstance(v, (list, tuple)) else v
                   for k, v in entry.items() if k in names and v is not None})


def _entries(data: dict, key: str, kind) -> list:
    return [_build(kind, e) for e in (data or {}).get(key) or [] if (e or {}).get("name")]


def load(spark: SparkSession, path: str) -> tuple[list[Bucket], list[Interest], list[TermGroup]]:
    """Buckets, interests and legend of a JSON or YAML file in any store that Spark reads; checked."""
    text = spark.read.text(path, wholetext=True).head()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional dependency, only for YAML files

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    out = _entries(data, "buckets", Bucket), _entries(data, "interests", Interest), _entries(data, "legend", TermGroup)
    check(*out)
    return out


def check(buckets: list[Bucket], interests: list[Interest] = (), legend: list[TermGroup] = ()) -> None:
    """Refuse configuration that would silently shortlist the wrong things."""
    problems = []
    names = {b.name for b in buckets}
    for b in buckets:
        stale = sorted(set(b.condition_in) - set(vocab.CONDITIONS))
        if stale:
            problems.append(f"{b.name}: unknown conditions {stale}")
    if interests:
        claimed = {n for i in interests for n in i.buckets}
        problems += [f"unknown bucket in an interest: {n}" for n in sorted(claimed - names)]
        problems += [f"bucket claimed by no interest: {n}" for n in sorted(names - claimed)]
    seen: set[str] = set()
    for g in legend:
        for term in g.terms:
            t = term.strip().lower()
            if not t or t in seen:
                problems.append(f"{g.name}: empty or repeated term {term!r}")
            seen.add(t)
    if problems:
        raise ValueError("configuration: " + "; ".join(problems))


def legend_terms(legend: list[TermGroup]) -> list[str]:
    return [t.strip().lower() for g in legend for t in g.terms]


def group_order(buckets: list[Bucket]) -> list[str]:
    return list(dict.fromkeys(b.group for b in buckets))


def bucket_table(spark: SparkSession, buckets: list[Bucket]) -> DataFrame:
    check(buckets)
    order = group_order(buckets)
    rows = [(b.name, b.group, order.index(b.group)) for b in buckets]
    return spark.createDataFrame(rows, "bucket string, bucket_group string, group_pos int")


def seed_table(spark: SparkSession, buckets: list[Bucket]) -> DataFrame:
    rows = [(b.name, fold_hyphens(s.strip()), s != s.rstrip()) for b in buckets for s in b.seeds]
    return spark.createDataFrame(rows, "bucket string, seed string, closed boolean")


def alias_table(spark: SparkSession, buckets: list[Bucket]) -> DataFrame:
    rows = [(a, b.name) for b in buckets for a in b.aliases]
    return spark.createDataFrame(rows, "old_name string, bucket string")


def term_table(spark: SparkSession, legend: list[TermGroup]) -> DataFrame:
    rows = [(g.name, t.strip(), gi) for gi, g in enumerate(legend) for t in g.terms]
    return spark.createDataFrame(rows, "term_group string, term string, group_pos int")
