"""Text expressions over descriptions, titles and labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def non_empty(c: Column) -> Column:
    """NULL for the empty string, so that coalesce skips it."""
    return F.nullif(c, F.lit(""))


def key_text(c: Column) -> Column:
    """Case- and padding-insensitive form used in product identities."""
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def canonical_condition(c: Column) -> Column:
    """Capitalise each run of letters: 'BRAND NEW - SEALED' -> 'Brand New - Sealed'."""
    known = F.create_map(*[F.lit(x) for v in vocab.CONDITIONS for x in (v.upper(), v)])
    capital = lambda r: F.when(
        r.rlike("^[A-Za-z']"), F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
    ).otherwise(r)
    runs = lambda v: F.regexp_extract_all(v, F.lit(r"([A-Za-z']+|[^A-Za-z']+)"), F.lit(1))
    # Grades of the vocabulary are looked up; only others are taken apart.
    return let(strip(c), lambda v: F.coalesce(
        F.try_element_at(known, F.upper(v)), F.array_join(F.transform(runs(v), capital), "")))


def _unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def _is_grade(stripped: Column) -> Column:
    return F.upper(stripped).isin([v.upper() for v in vocab.CONDITIONS])


def _labelled_grade(text: Column) -> Column:
    line = strip(F.regexp_extract(text, r"(?dim)^condition:\s*(.+)$", 1))
    return let(line, lambda v: F.when(
        (v != "") & ~F.upper(v).isin(*vocab.CONDITION_PLACEHOLDERS), canonical_condition(v)))


def _free_text(text: Column) -> Column:
    lines = F.split(text, r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    free = F.filter(lines, lambda l: ~strip(l).rlike(r"^[A-Za-z0-9 .'\-]+[?:]"))
    return strip(F.array_join(free, "\n"))


def parse_description(description: Column) -> Column:
    """struct(condition, rest) of a description, each part read once.

    A description that is nothing but a known grade is the grade; otherwise the
    first 'Condition:' line counts, and every 'Label: value' or 'Label? value'
    line is dropped from the rest.
    """
    return let(_unix_lines(F.coalesce(description, F.lit(""))), lambda t: F.when(
        _is_grade(strip(t)), F.struct(canonical_condition(t).alias("condition"), F.lit("").alias("rest"))
    ).otherwise(F.struct(_labelled_grade(t).alias("condition"), _free_text(t).alias("rest"))))


def condition_of(description: Column) -> Column:
    """The grade a description carries, or NULL."""
    return parse_description(description)["condition"]


def clean_description(description: Column) -> Column:
    """Free text left after the labelled lines are dropped."""
    return parse_description(description)["rest"]


def normalise_subtype(c: Column) -> Column:
    return let(F.lower(strip(F.regexp_replace(c, r"\s+", " "))), lambda v: F.when(v != "", v))


def dedup_ordered(values: Column) -> Column:
    """Distinct non-empty entries, first occurrence first."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def fold_literal(s: str) -> str:
    """Lower case without the accents U+0300 to U+036F; what else decomposes is put together again."""
    decomposed = unicodedata.normalize("NFD", (s or "").lower())
    return unicodedata.normalize("NFC", "".join(ch for ch in decomposed if not "\u0300" <= ch <= "\u036f"))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(characters, replacements) of fold_literal: accented letters to their base, marks to nothing."""
    accented, base, marks = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        ch = chr(code)
        if ch != ch.lower():
            continue  # lower case comes first
        folded = fold_literal(ch)
        if not folded:
            marks.append(ch)
        elif folded != ch and len(folded) == 1:
            accented.append(ch)
            base.append(folded)
    return "".join(accented + marks), "".join(base)


def fold_text(c: Column) -> Column:
    """fold_literal of a column."""
    accented, base = _accent_table()
    # Plain ASCII text, the usual case, skips the per-character lookup.
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda v: F.when(
        v.rlike(r"[^\x00-\x7f]"), F.translate(v, accented, base)).otherwise(v))


def tokens_of(query: str) -> list[str]:
    return fold_literal(query.strip()).split()


def seed_normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[-/]+", " ")


def _is_line_code(word: Column) -> Column:
    return (F.length(word) <= 2) | word.rlike("[0-9]")


def _product_words(title: Column) -> Column:
    cleaned = F.regexp_replace(F.upper(F.coalesce(title, F.lit(""))), "[^A-Z0-9 ]", " ")
    return F.filter(F.split(cleaned, " +"), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))


def sibling_key(title: Column, words: int = 3) -> Column:
    """Leading product words of a title, or NULL when they name no family.

    Three words need two alphabetic ones; two words must be a name and a code.
    """
    alphabetic = lambda w: w.rlike("^[A-Z]+$")

    def key(lead: Column) -> Column:
        if words >= 3:
            ok = F.size(F.filter(lead, alphabetic)) >= 2
        else:
            ok = alphabetic(F.get(lead, F.lit(0))) & _is_line_code(F.get(lead, F.lit(1)))
        return F.when((F.size(lead) == words) & ok, F.array_join(lead, " "))

    return let(F.slice(_product_words(title), 1, words), key)


def title_brand(title: Column) -> Column:
    """Leading word of a title in lower case, unless it is a size, code or filler."""
    first = F.regexp_extract(F.upper(F.coalesce(title, F.lit(""))), r"[A-Z0-9][A-Z0-9'&.+-]*", 0)
    return let(F.btrim(first, F.lit("'.-+&")), lambda word: F.when(
        ~_is_line_code(word) & ~word.isin(*vocab.FILLER_WORDS), F.lower(word)))
