"""Plain counterparts of the operators, on lists."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lotlens.llm import secrets


def ids(text: str, end: int) -> list[int]:
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(x: list[int]) -> int:
    return zlib.crc32(np.array(x, "<u4").tobytes())


def top(rows: list[tuple[int, list]], k: int, every: int = 20) -> list[tuple]:
    fine = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def windows_removed(texts: list[str], span: int) -> list[tuple[int, int, str]]:
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k:k + span]) for w in rows for k in range(len(w) - span + 1))
    out = []
    for w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if count[tuple(w[k:k + span])] > 1:
                gone[k:k + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def runs(text: str, n: int = 5) -> frozenset:
    w = plain_words(text)
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_groups(docs: list[tuple[int, str]], threshold: float = 0.8) -> dict[int, tuple[int, int, int]]:
    """doc_id: class, copy, links."""
    sets = {d: runs(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        if s:
            by[s].append(d)
    kinds = list(by)
    where = defaultdict(list)
    for k, s in enumerate(kinds):
        for r in s:
            where[r].append(k)
    shared = Counter()
    for some in where.values():
        for a in range(len(some)):
            for b in range(a + 1, len(some)):
                shared[some[a], some[b]] += 1
    parent = list(range(len(kinds)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for (a, b), n in shared.items():
        if n >= threshold * (len(kinds[a]) + len(kinds[b]) - n) - 1e-9:
            links[a] += len(by[kinds[b]])
            links[b] += len(by[kinds[a]])
            parent[find(a)] = find(b)
    least = {}
    for k, s in enumerate(kinds):
        least[find(k)] = min(least.get(find(k), min(by[s])), min(by[s]))
    out = {d: (d, d, 0) for d, s in sets.items() if not s}
    for k, s in enumerate(kinds):
        for d in by[s]:
            out[d] = (least[find(k)], min(by[s]), links[k] + len(by[s]) - 1)
    return out


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]], least: int = 13, share: float = 0.8) -> set[tuple[int, int]]:
    """(doc_id, item_id) with a stretch of one diagonal that agrees in enough words; every diagonal is tried."""
    out = set()
    for i, a in items:
        a = plain_words(a)
        if len(a) < 8:
            continue
        need = min(least, -(-len(a) * 4 // 5))
        for d, b in docs:
            b = plain_words(b)
            if len(set(a) & set(b)) < need / 2:
                continue
            for line in range(-len(a) + 1, len(b)):
                lo, hi = max(0, -line), min(len(a), len(b) - line)
                if hi - lo < need:
                    continue
                same = np.array([a[k] == b[k + line] for k in range(lo, hi)])
                if same.sum() < need:
                    continue
                total = np.concatenate([[0], np.cumsum(same)])
                if any((total[e] - total[s]) >= max(need, share * (e - s)) for s in range(len(total)) for e in range(s + 1, len(total))):
                    out.add((d, i))
                    break
    return out


def secret_spans(text: str, reach: int = secrets.REACH) -> tuple[list[tuple], list[tuple]]:
    """Base spans and all spans as (start, kind, end)."""
    parts = []
    for kind, role, strong, pattern, group, least in secrets.KINDS:
        for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m.group(group)) >= least:
                parts.append((m.start(), kind, m.end(), role, strong))
    base = [p for p in parts if p[4]]
    weak = [p for p in parts if not p[4] and not any(s[0] < p[2] and p[0] < s[2] for s in base)]
    every = base + weak
    wanted = lambda p, q: q[3] in ("identifier", "endpoint") if p[1] == "secret" else q[3] == "secret"
    more = [p for p in weak if any(abs(p[0] - q[0]) <= reach and wanted(p, q) for q in every)]
    key = lambda p: (p[0], secrets.ORDER.index(p[1]))
    return sorted((p[:3] for p in base), key=key), sorted((p[:3] for p in {*base, *more}), key=key)
