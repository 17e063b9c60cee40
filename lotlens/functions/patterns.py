"""Regular expressions built from configured terms. Driver-side strings only."""

from __future__ import annotations

import re


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-/&#~])", r"\\\1", text)


def fold_hyphens(text: str) -> str:
    return re.sub(r"[-/]+", " ", text.lower())


def shortlist_pattern(seeds: list[str]) -> str | None:
    """Left-anchored alternation, longest term first; a trailing space anchors the right."""
    usable = [s for s in seeds if s and s.strip()]
    if not usable:
        return None
    folded = [(fold_hyphens(s.strip()), s != s.rstrip()) for s in usable]
    folded.sort(key=lambda t: len(t[0]), reverse=True)
    # (?U): a word boundary also counts letters outside ASCII.
    return r"(?U)\b(" + "|".join(quote(t) + (r"\b" if closed else "") for t, closed in folded) + ")"


def title_seed_pattern(seeds: list[str], min_len: int) -> str | None:
    """The looser title-only matcher of the recall check: no hyphen folding."""
    usable = [s for s in seeds if len(s) >= min_len]
    if not usable:
        return None
    return r"(?iuU)\b(" + "|".join(quote(s) for s in usable) + ")"


def anywhere_pattern(terms: list[str]) -> str | None:
    return "(?iu)" + "|".join(quote(t) for t in terms) if terms else None


def phrase_pattern(tokens: list[str]) -> str:
    """Tokens as whole adjacent words, an optional plural at the end."""
    body = r"\s+".join(quote(t) for t in tokens)
    return rf"(?<![a-z0-9]){body}(?:e?s)?(?![a-z0-9])"
