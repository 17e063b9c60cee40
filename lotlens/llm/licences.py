"""Operator 3: licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences twice: with its line ends as blanks (licence texts are wrapped), but for those of blank
lines, and line by line (one-line notices stand without a full stop). Each normalised sentence (lower case, runs of
other characters than letters, digits, point and plus as one blank) becomes an identifier if it is a known licence
sentence, if it is one but for a name (HOLES), or if it says under which licence something is (``in-`` and the licence
that NAMES has for what it says). SPDX lines are read by their own rule: every known identifier of the expression counts.

Ordered rules then take sequences of identifiers out of the list: the first rule that fits wins its sentences, so longer
rules stand first. Unknown sentences stay in the list as marks. At most GAP of them may stand between two neighbours of a
sequence; more part them (``=``), so two ends of a licence far from each other are none.

Every text is cut, as no word stands in every known sentence. Null and empty texts have no licence. Each row
is scanned for itself, so ties, copies and clashing column names don't matter, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two sentences of one licence.
GAP = 2

# Sentences of public licences in normalised form, with the identifier of each.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under the apache license version 2.0 the license": "apache-header",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-language",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-copy",
    "all rights reserved": "reserved",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "boost software license version 1.0 august 17th 2003": "bsl-title",
    "eclipse public license v 2.0": "epl2-title",
    "eclipse public license v 1.0": "epl1-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": "epl2-header",
    "mozilla public license version 2.0": "mpl2-title",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
    "apache license": "apache-title",
    "version 2.0 january 2004": "apache-date",
    "version 3 19 november 2007": "v3-november",
    "version 3 29 june 2007": "v3-june",
    "version 2 june 1991": "v2-june",
    "version 2.1 february 1999": "v2.1-february",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-implied",
}

# Sentences that hold a name, as patterns.
_OWNER = "[a-z0-9.+ ]{1,120}"
HOLES = (
    (rf"^neither the names? of {_OWNER} nor the names of (its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission$", "bsd-endorse"),
    (rf"^this software is provided by {_OWNER} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$", "bsd-warranty"),
    (rf"^in no event shall {_OWNER} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software$", "mit-liability"),
)

# The GNU family: its sentences differ by the licence's first name and version only.
_GNU = {"gpl": "", "lgpl": "lesser ", "agpl": "affero "}
_GNU_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2.1", "3"), "agpl": ("3",)}


def _gnu_sentences() -> dict[str, str]:
    out = {}
    for kind, name in _GNU.items():
        out[f"gnu {name}general public license"] = f"{kind}-title"
        out[f"see the gnu {name}general public license for more details"] = f"{kind}-details"
        for thing in ("program", "library"):
            out[f"this {thing} is free software"] = "gnu-free"
            out[f"this {thing} is distributed in the hope that it will be useful but without any warranty"] = "gnu-warranty"
        terms = f"you can redistribute it and or modify it under the terms of the gnu {name}general public license as published by the free software foundation"
        out[terms] = f"{kind}-terms"
        for v in _GNU_VERSIONS[kind]:
            later = f"either version {v} of the license or at your option any later version"
            out[later] = f"v{v}-later"
            out[f"{terms} {later}"] = f"{kind}{v}-grant"
    return out


SENTENCES |= _gnu_sentences()


def _gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    whole, grants, titles = [], [], []
    dates = {("gpl", "2"): "v2-june", ("gpl", "3"): "v3-june", ("lgpl", "2.1"): "v2.1-february", ("lgpl", "3"): "v3-june", ("agpl", "3"): "v3-november"}
    for kind, versions in _GNU_VERSIONS.items():
        for v in versions:
            name = f"{kind.upper()}-{v if '.' in v else v + '.0'}"
            for grant in ((f"{kind}{v}-grant",), (f"{kind}-terms", f"v{v}-later")):
                whole.append((f"{name}-or-later", (*grant, "gnu-warranty", "gnu-implied", f"{kind}-details")))
                grants.append((f"{name}-or-later", grant))
            titles.append((f"{name}-only", (f"{kind}-title", dates[kind, v])))
    return whole + grants + titles


# Names of licences, as they stand after "licensed under" and the like.
_LINES = {
    "MIT": ("mit", "mit x11", "expat"), "BSD": ("bsd",), "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"), "0BSD": ("0bsd", "zero clause bsd"), "ISC": ("isc",),
    "Apache-2.0": ("apache", "apache 2", "apache 2.0", "apache version 2.0", "apache license 2.0", "apache license version 2.0", "apache license v2.0"),
    "Zlib": ("zlib",), "Unlicense": ("unlicense",), "BSL-1.0": ("boost software license 1.0", "boost software license version 1.0", "boost", "bsl 1.0"),
    "MPL-2.0": ("mpl 2.0", "mozilla public license 2.0", "mozilla public license version 2.0", "mozilla public license v2.0"),
    "EPL-1.0": ("epl 1.0", "eclipse public license 1.0", "eclipse public license v1.0"),
    "EPL-2.0": ("epl 2.0", "eclipse public license 2.0", "eclipse public license v2.0"),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0 1.0 universal"),
}


def _names() -> dict[str, str]:
    """What a notice may say, and the SPDX identifier: with or without the word licence, GNU and Creative Commons by rule."""
    out = {}
    for spdx, says in _LINES.items():
        for one in says:
            out |= {one: spdx, f"{one} license": spdx, f"{one} licence": spdx}
    for kind, name in _GNU.items():
        for v in _GNU_VERSIONS[kind]:
            spdx = f"{kind.upper()}-{v if '.' in v else v + '.0'}"
            for one in (f"{kind} {v}", f"{kind} v{v}", f"{kind}v{v}", f"{kind} {v}.0", f"{kind} v{v}.0", f"{kind} version {v}",
                        *(f"gnu {name}general public license {w}" for w in (v, f"v{v}", f"version {v}", f"{v}.0", f"v{v}.0", f"version {v}.0")),
                        f"gnu {kind} v{v}", f"gnu {kind} {v}", f"gnu {kind}v{v}"):
                out |= {one: f"{spdx}-only", f"{one} only": f"{spdx}-only", f"{one} or later": f"{spdx}-or-later"}
    parts = {"BY": "attribution", "NC": "noncommercial", "SA": "sharealike", "ND": "noderivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            full = " ".join(parts[p] for p in kind.split("-"))
            short = kind.lower().replace("-", " ")
            for one in (f"cc {short} {v}", f"creative commons {short} {v}", f"creative commons {full} {v}", f"creative commons {full} {v} international",
                        f"creative commons {full} {v} unported"):
                out |= {one: f"CC-{kind}-{v}", f"{one} license": f"CC-{kind}-{v}"}
    return out


NAMES = _names()
#: SPDX identifiers that a notice or an SPDX line may give, by their lower case.
IDENTIFIERS = {n.lower(): n for n in sorted(set(NAMES.values()))}

# Licences with the sequence of sentence identifiers that tells them, in order of precedence.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-warranty", "apache-language")),
    *_gnu_rules(),
    ("MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-compliance")),
    ("Apache-2.0", ("apache-title", "apache-date")),
    ("MPL-2.0", ("mpl2-header",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-title",)),
    ("EPL-2.0", ("epl2-header",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("Apache-2.0", ("apache-header",)),
    ("Unlicense", ("unlicense",)),
    *((n, (f"in-{n}",)) for n in IDENTIFIERS.values()),
)

#: A sentence ends at a mark and a blank, but not within 'v. 2.0'.
_END = r"(?i)((?<![ \t]v)\.|\.(?=[ \t]+[^0-9 \t])|[!?;:])[ \t]+"
#: A single line end is a blank; one before a line without words (comment marks, rules) ends the paragraph and its sentence.
_WRAP, _OTHER = r"\r?\n(?![ \t#*/;%-]*\r?\n)", r"[^a-z0-9.+]+"
_UNDER = r"\b(?:licensed|licenced|released|available|distributed|published) under (?:an? |the )?(?:terms of )?(?:an? |the )?(.+)$"
#: What may follow the name of a licence.
_AFTER = r" (?:see|which|as|in|with|and|at|from|found|unless|by) .*$"
_SPDX = r"(?i)spdx-license-identifier[ \t]*:([^\r\n]*)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _identifier(s: Column, known: Column, names: Column) -> Column:
    """The identifier of a normalised sentence, a dash for an unknown one."""
    said = F.regexp_extract(s, _UNDER, 1)
    named = F.coalesce(F.try_element_at(names, said), F.try_element_at(names, F.regexp_replace(said, _AFTER, "")))
    holes = F.coalesce(*(F.when(s.rlike(p), F.lit(i)) for p, i in HOLES))
    return F.coalesce(F.try_element_at(known, s), F.when(F.contains(s, F.lit(" under ")), F.concat(F.lit("in-"), named)),
                      F.when(F.length(s) > 100, holes), F.lit("-"))


def _identified(text: Column, known: Column, names: Column) -> Column:
    """Identifiers of the sentences of a text that is cut at line ends and after sentence marks."""
    cut = F.split(F.regexp_replace(text, _END, "$1\n"), "\n")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), _OTHER, " ")), r"^[0-9]+\. |[. ]+$", "")))
    return F.transform(F.filter(plain, lambda s: s != ""), lambda s: _identifier(s, known, names))


def _joined(ids: Column) -> Column:
    """Identifiers as text with a bar on either side of each; few unknown sentences are passed over, more part their neighbours."""
    every = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("|"))), ""))
    return F.replace(F.regexp_replace(every, rf"(?:-\|){{{GAP + 1},}}", "=|"), F.lit("-|"), F.lit(""))


def _spdx(text: Column, identifiers: Column) -> Column:
    """Known identifiers of the SPDX lines of a text, each once, in order of name."""
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda x: F.split(F.lower(x), r"[^a-z0-9.+-]+")))
    return F.array_sort(F.array_compact(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("in-"), F.try_element_at(identifiers, x))))))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: tuple | None = None) -> DataFrame:
    """The documents with ``sentence_ids`` (of the wrapped reading, line by line, and of SPDX lines) and ``licences``.

    Columns of those names are replaced. ``licences`` is in the order of the rules, each once.
    """
    known, names, rules = _map(sentences or SENTENCES), _map(NAMES), rules or RULES
    kept = [c for c in docs.columns if c not in ("sentence_ids", "licences")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wrapped = _identified(F.regexp_replace(text, _WRAP, " "), known, names)
    lines = _identified(text, known, names)
    every = F.concat(_joined(wrapped), F.lit("#"), _joined(lines), F.lit("#"), _joined(_spdx(text, _map(IDENTIFIERS))))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(ids) + "|").alias("ids")) for name, ids in rules))
    begin = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("found"))

    def take(acc: Column, rule: Column) -> Column:
        fits = F.contains(acc["left"], rule["ids"])
        return F.struct(F.replace(acc["left"], rule["ids"], F.lit("|=|")).alias("left"),
                        F.when(fits, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    out = docs.select(*kept, every.alias("sentence_ids"))
    none = F.array().cast("array<string>")
    found = F.when(F.col("sentence_ids").rlike("[a-z]"), F.aggregate(table, begin, take, lambda acc: acc["found"])).otherwise(none)
    return out.select("*", found.alias("licences"))


def digests(rows: DataFrame) -> DataFrame:
    """n_sentences counts the known sentences of the line-by-line reading."""
    ids = F.filter(F.split(F.element_at(F.split("sentence_ids", "#"), 2), r"\|"), lambda x: ~x.isin("", "="))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(ids).cast("long").alias("n_sentences"), "sentence_ids",
                       F.array_join("licences", ",").alias("licences"))


def oracle(table: str = "documents") -> str:
    """The scan as DuckDB SQL, from the rules of the module: sentences as rows, licences by taking each rule in turn."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = lambda d: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in d.items())
    holes = " ".join(f"when regexp_matches(u.s, {quote(p)}) then {quote(i)}" for p, i in HOLES)
    rules = ", ".join(f"({k}, {quote(n)}, {quote('|' + '|'.join(ids) + '|')})" for k, (n, ids) in enumerate(RULES))
    return rf"""
with recursive known(s, id) as (values {pairs(SENTENCES)}),
names(said, spdx) as (values {pairs(NAMES)}),
identifiers(low, spdx) as (values {pairs(IDENTIFIERS)}),
rules(k, name, ids) as (values {rules}),
t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ln from {table}),
unwrapped as (select rid, array_to_string([case when i < len(ln) then regexp_replace(ln[i], '\r$', '') else ln[i] end || case when i = len(ln) then '' when i + 1 < len(ln)
    and regexp_full_match(ln[i + 1], '[ \t#*/;%-]*\r?') then chr(10) else ' ' end for i in range(1, len(ln) + 1)], '') as text from t),
readings as (select rid, 1 as reading, text from unwrapped union all select rid, 2, text from t),
kept as (select rid, reading, regexp_replace(text, '([ \t][vV]\.)([ \t]+[0-9])', '\1' || chr(57344) || '\2', 'g') as text from readings),
cut as (select rid, reading, string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) as parts from kept),
sentences as (select rid, reading, unnest(range(1, len(parts) + 1)) as n,
    unnest([trim(regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g')), '^[0-9]+\. |[. ]+$', '', 'g')) for s in parts]) as s from cut),
under as (select *, case when contains(s, ' under ') then regexp_extract(s, '{_UNDER}', 1) else '' end as said from sentences where s <> ''),
found as (select rid, reading, n, coalesce(known.id, 'in-' || a.spdx, 'in-' || b.spdx, case when length(u.s) > 100 then case {holes} end end, '-') as id
  from under u left join known on known.s = u.s left join names a on a.said = u.said left join names b on b.said = regexp_replace(u.said, '{_AFTER}', '')),
spdx as (select rid, 3 as reading, unnest(flatten([regexp_split_to_array(lower(x), '[^a-z0-9.+-]+') for x in regexp_extract_all(text, '{_SPDX}', 1)])) as low from t),
listed as (select rid, reading, n, id from found union all select distinct rid, 3, 0, 'in-' || i.spdx from spdx join identifiers i using (low)),
joined as (select rid, reading, '|' || string_agg(id || '|', '' order by n, id) as ids, count(*) filter (id <> '-') as known from listed group by all),
marked as (select rid, reading, known, replace(regexp_replace(ids, '(?:-\|){{{GAP + 1},}}', '=|', 'g'), '-|', '') as ids from joined),
shown as (select t.rid, t.doc_id, coalesce(b.known, 0) as n_sentences, coalesce(a.ids, '|') || '#' || coalesce(b.ids, '|') || '#' || coalesce(c.ids, '|') as sentence_ids
  from t left join marked a on a.rid = t.rid and a.reading = 1 left join marked b on b.rid = t.rid and b.reading = 2 left join marked c on c.rid = t.rid and c.reading = 3),
taken(rid, k, fits, left_over) as (
  select rid, -1, false, sentence_ids from shown where regexp_matches(sentence_ids, '[a-z]')
  union all
  select rid, r.k, contains(left_over, ids), replace(left_over, ids, '|=|') from taken join rules r on r.k = taken.k + 1),
first as (select rid, name, min(k) as k from taken join rules using (k) where fits group by all)
select doc_id, n_sentences, sentence_ids, coalesce((select string_agg(name, ',' order by k) from first f where f.rid = shown.rid), '') as licences from shown"""
