"""Operators 3, 5, 7 and 8 on texts of every kind."""

import hashlib
import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import crossentropy, licences, secrets, toxicity

ODD = [(1, None), (2, ""), (2, "plain words"), (3, "x " * 20000), (None, "no id"), (3, "x " * 20000), (4, "ñ 日本 \U0001f600")]

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
       "files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, "
       "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software "
       "is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
       "included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
       "KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND "
       "NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER "
       "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
       "IN THE\nSOFTWARE.\n")


def test_licences_by_ordered_rules(documents):
    rows = ODD + [(10, MIT), (11, "some prose. Released under the MIT License.\nMore prose"),
                  (12, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
                  (13, "the above copyright notice alone is no licence"),
                  (14, MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")),
                  (15, "# SPDX-License-Identifier: MIT\ncode")]
    got = {r.doc_id: r.licences for r in licences.scan(documents(rows)).where("doc_id >= 10").collect()}
    assert got == {10: ["MIT"], 11: ["MIT"], 12: ["Apache-2.0", "CC-BY-NC-4.0"], 13: [], 14: ["MIT"], 15: ["MIT"]}
    assert all(r.licences == [] for r in licences.scan(documents(ODD)).collect())
    assert licences.scan(documents([])).count() == 0


NOTICES = {
    "SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"], "// SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0-only"],
    "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: Nothing-1.0": [],
    "Licensed under the MIT license (see LICENSE).": ["MIT"], "This project is licensed under the Apache License 2.0.": ["Apache-2.0"],
    "Code is available under the MIT License.": ["MIT"], "Licensed under CC BY-SA 3.0": ["CC-BY-SA-3.0"],
    "This text is released under a CC BY-NC-ND 4.0 license.": ["CC-BY-NC-ND-4.0"], "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n": ["AGPL-3.0-only"],
    "Licensed under the GNU Lesser General Public License v3.0 or later.": ["LGPL-3.0-or-later"], "Mozilla Public License Version 2.0\n====": ["MPL-2.0"],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    "Boost Software License - Version 1.0 - August 17th, 2003": ["BSL-1.0"], "Eclipse Public License - v 2.0": ["EPL-2.0"],
    "The road is under the bridge. Licensed under the stars": [],
}


def test_notices_of_many_kinds(documents):
    got = {r.doc_id: r.licences for r in licences.scan(documents(list(enumerate(NOTICES)))).collect()}
    assert [sorted(got[k]) for k in range(len(NOTICES))] == list(NOTICES.values())


def test_sentences_far_apart_are_no_neighbours(documents):
    grant, notice = MIT.split("\n\n")[:2]
    far = "\n".join(f"A line of prose number {k}." for k in range(300))
    rows = [(1, f"{grant}\n\n{far}\n\n{notice}"), (2, f"{grant}\n\nOne line.\n\n{notice}"),
            (3, f"{grant}\n\n" + "x. " * licences.GAP + f"\n\n{notice}"), (4, f"{grant}\n\n" + "x. " * (licences.GAP + 1) + f"\n\n{notice}")]
    got = {r.doc_id: r.licences for r in licences.scan(documents(rows)).collect()}
    assert got == {1: [], 2: ["MIT"], 3: ["MIT"], 4: []}


def test_named_owners(documents):
    text = BSD.replace("the copyright holder nor", "the Example Project nor") if "the copyright holder nor" in BSD else BSD
    assert licences.scan(documents([(1, text)])).first().licences == licences.scan(documents([(1, BSD)])).first().licences


def test_licences_same_as_sql(documents):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(20, MIT), (21, "A. Released under the MIT License.\r\n  B"), (22, MIT + MIT),
            (23, "Licensed under the Apache License, Version 2.0; Licensed under CC BY 4.0. All rights reserved.")]
    rows += list(enumerate(NOTICES, 30)) + [(60, GPL.format("program", ":", "", ",", "3")), (61, "a\r\n\r\n# \r\nAll rights reserved\r\n\r\nx v. 2 y V. z 1. 2"), (62, "\n\n"), (63, BSD)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(licences.oracle())
    names = [d[0] for d in want.description]
    got = licences.digests(licences.scan(documents(rows))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_a_longer_rule_goes_first(documents):
    known, rules = {"aa": "a", "bb": "b", "cc": "c"}, (("long", ("a", "b")), ("short", ("a",)), ("c", ("c",)))
    got = licences.scan(documents([(1, "aa. bb. license"), (2, "aa. x. bb. license"), (3, "aa. bb. aa. license cc")]), known, rules)
    assert {r.doc_id: r.licences for r in got.collect()} == {1: ["long"], 2: ["long"], 3: ["long", "short"]}


GPL = ("This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2}General Public License as published by\n"
       "the Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\nThis {0} is distributed in "
       "the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A "
       "PARTICULAR PURPOSE.  See the GNU\n{2}General Public License for more details.\n")
BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are "
       "met:\n\n1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following "
       "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following "
       "disclaimer in the\n   documentation and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
       "HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF "
       "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.\n")
ENDORSE = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
           "   this software without specific prior written permission.\n\n")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou "
          "may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
          "writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
          "express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n")
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
       "file, You can obtain one at https://mozilla.org/MPL/2.0/.\n")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the "
       "above\ncopyright notice and this permission notice appear in all copies.\n")
OFFICIAL = [
    ("MIT", MIT), ("MIT", MIT[:MIT.index("THE SOFTWARE IS")]), ("MIT", "Released under the MIT License."), ("MIT", "/* SPDX-License-Identifier: MIT */\ncode"),
    ("BSD-3-Clause", BSD.format(ENDORSE)), ("BSD-2-Clause", BSD.format("")), ("Apache-2.0", APACHE[:APACHE.index("You may ob")]),
    ("Apache-2.0", APACHE[:APACHE.index("you may not")]), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\ncode"),
    ("GPL-3.0-or-later", GPL.format("program", ":", "", ",", 3)), ("GPL-3.0-or-later", GPL.format("program", ";", "", ";", 3)),
    ("GPL-2.0-or-later", GPL.format("program", ";", "", ";", 2)), ("GPL-2.0-or-later", GPL.format("program", ";", "", ",", 2)),
    ("LGPL-2.1-or-later", GPL.format("library", ";", "Lesser ", ";", 2.1)), ("LGPL-2.1-or-later", GPL.format("library", ";", "Lesser ", ",", 2.1)),
    *((n, GPL.format("program", *x).split("\n\n")[0]) for n, x in (("GPL-3.0-or-later", (":", "", ",", 3)), ("GPL-2.0-or-later", (";", "", ";", 2)),
                                                                  ("LGPL-2.1-or-later", (";", "Lesser ", ";", 2.1)))),
    ("GPL-3.0-or-later", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode"), ("MPL-2.0", MPL), ("MPL-2.0", MPL[:MPL.index(" If a")]), ("ISC", ISC),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("BSD", "Licensed under the BSD license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]


def test_every_licence_by_its_official_text(documents):
    got = {r.doc_id: r for r in licences.scan(documents([(k, t) for k, (_, t) in enumerate(OFFICIAL)])).collect()}
    assert [got[k].licences for k in range(len(OFFICIAL))] == [[n] for n, _ in OFFICIAL]


def test_every_rule_takes_its_sentences(documents):
    say = {i: s for s, i in reversed(licences.SENTENCES.items())} | {"bsd-endorse": None}
    rules = [(n, ids) for n, ids in licences.RULES if all(say.get(i) for i in ids)]
    assert len(rules) > 35
    rows = [(k, "\n".join(say[i].capitalize() + "." for i in ids)) for k, (_, ids) in enumerate(rules)]
    got = {r.doc_id: r.licences for r in licences.scan(documents(rows)).collect()}
    assert got == {k: [n] for k, (n, _) in enumerate(rules)}


def test_every_name_in_a_notice(documents):
    said = sorted(licences.NAMES)
    rows = [(k, f"This file is licensed under the {n}.") for k, n in enumerate(said)]
    got = {r.doc_id: r.licences for r in licences.scan(documents(rows)).collect()}
    assert got == {k: [licences.NAMES[n]] for k, n in enumerate(said)}
    rows = [(k, f"x\n; spdx-license-identifier: {n} WITH Some-exception AND nothing\n") for k, n in enumerate(licences.IDENTIFIERS)]
    got = {r.doc_id: r.licences for r in licences.scan(documents(rows)).collect()}
    assert got == {k: [n] for k, n in enumerate(licences.IDENTIFIERS.values())}


def test_abbreviations_end_sentences_elsewhere(documents):
    rows = [(1, "See part v. Released under the MIT License. Done"), (2, "Licence: Released under the MIT License. Done")]
    assert [r.licences for r in licences.scan(documents(rows)).collect()] == [["MIT"]] * 2


def test_whole_licence_files(documents):
    line = "Copyright (c) 2020 Some Body"
    rows = [(1, f"MIT License\n\n{line}\n\n{MIT}"), (2, f"MIT License\r\n \r\n{line}\r\n\r\n" + MIT.replace("\n", "\r\n")), (3, f"ISC License\n\n{line}\n\n{ISC}"),
            (4, f"{line}\n\n" + BSD.format(ENDORSE)), (5, f"{line}\n\n" + BSD.format("")),
            (6, "".join(f"# {x}".rstrip() + "\n" for x in f"The MIT License\n\n{line}\n\n{MIT}".split("\n"))), (7, f"{line}\n\n{APACHE}"),
            (8, "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in f"{line}\n\n{APACHE}".split("\n")) + " */\ncode")]
    got = {r.doc_id: r for r in licences.scan(documents(rows)).collect()}
    assert [got[k].licences for k in range(1, 9)] == [["MIT"], ["MIT"], ["ISC"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["MIT"], ["Apache-2.0"], ["Apache-2.0"]]
    for k in (7, 8):
        assert "|apache-header|apache-compliance|apache-warranty|apache-language|" in got[k].sentence_ids


def test_every_known_sentence_is_found_alone(documents):
    known = licences.SENTENCES
    keys = [s for s in known if " v. " not in s]
    got = {r.doc_id: r.sentence_ids for r in licences.scan(documents([*enumerate(k.capitalize() + "." for k in keys)])).collect()}
    assert got == {k: f"|{known[s]}|#|{known[s]}|#|" for k, s in enumerate(keys)}
    rows = [(1, "All rights reserved."), (2, "You said: All rights\nreserved. So")]
    assert [(r.doc_id, r.n_sentences, r.sentence_ids) for r in licences.digests(licences.scan(documents(rows))).orderBy("doc_id").collect()] == [
        (1, 1, "|reserved|#|reserved|#|"), (2, 0, "|reserved|#|=|#|")]


def secret_rows():
    r = random.Random(6)
    words = ["password", "Secret", "token", "API_KEY", "apikey", "passwd", "AKIA", "AKIAABCDEFGH1234567", "=", ": ", "= '", "\"", " ", "\n",
             "deadbeef", "0123456789abcdef0", "abcDEF123456", "short", "user: bob1", "https://db.example.com/x", "pwd=hunter22", "ñ", "é日 ", "login=x12",
             "postgres://h/p", "token=token=aaaaaaaaaaaaaa", "x" * 300]
    return [(100 + k, "".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(400)]


def test_secrets_of_a_text_full_of_parts(documents):
    """Many parts in one text, weak ones under strong ones, spans and text over the bounds of blocks."""
    text = "token=abcdefghijklmnop user=someone é secret=abc " * 900 + "password=0123456789abcdef0123 pwd: xyzzy " * 300
    rows = documents([(1, text), (2, "x" * 700), (3, "")])
    got = {r.doc_id: r for r in secrets.scan(rows).join(rows.select(F.col("doc_id").alias("d"), "text"), F.col("d") == F.col("doc_id"))
           .select("doc_id", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("out")).collect()}
    _, want = brute.secret_spans(text)
    assert [(s.start, s.kind, s.stop) for s in got[1].spans] == [tuple(w) for w in want]
    out, at = [], 0
    for start, kind, stop in want:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    assert got[1].out == "".join(out) + text[at:]
    assert (got[2].spans, got[2].out, got[3].out) == ([], "x" * 700, "")


def test_secrets_same_as_by_hand(documents):
    rows = secret_rows() + [(k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(documents(rows))).collect()}
    linked = 0
    for doc, text in rows:
        base, every = brute.secret_spans(text)
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert got[doc].base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest(), text
        assert got[doc].spans == listed(every), text
        assert (got[doc].n_assign, got[doc].n_access, got[doc].n_hex) == tuple(sum(k == x for _, x, _ in base) for k in secrets.BASE)
        linked += len(every) > len(base)
    assert linked > 20


def test_weak_candidates_alone_are_not_reported(documents):
    far = " word" * 80
    rows = [(1, "pwd=hunter22"), (2, "pwd=hunter22 user: bob1"), (3, f"pwd=hunter22{far} user: bob1"), (4, "user: bob1 at https://db.example.com/x")]
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(documents(rows))).collect()}
    assert got == {1: "", 2: "secret:0:12,identifier:13:23", 3: "", 4: ""}


def test_texts_with_very_many_matches(documents):
    text = "0123456789abcdef " * 3000
    got = secrets.digests(secrets.scan(documents([(1, text), (1, text), (None, text)]))).collect()
    assert [r.n_hex for r in got] == [3000] * 3
    _, every = brute.secret_spans(text)
    assert {r.spans for r in got} == {",".join(f"{k}:{a}:{b}" for a, k, b in every)}
    assert secrets.scan(documents([])).count() == 0


def test_redaction(documents, spark):
    rows = secret_rows()
    found = secrets.scan(documents(rows)).join(documents(rows).select(F.col("doc_id").alias("d"), "text"), F.col("d") == F.col("doc_id"))
    for r in found.select("text", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("out")).collect():
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at:s.start] + f"[{s.kind}]"
            at = max(at, s.stop)
        assert r.out == want + r.text[at:]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    common, bad = [f"w{k}ord" for k in range(60)], ["stupidest", "trashy", "loserish"]
    rows = []
    for k in range(1500):
        w = [r.choice(common) for _ in range(r.randint(3, 60))]
        toxic = k % 8 == 0
        if toxic:
            w.insert(r.randint(0, len(w)), r.choice(bad))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity_is_learnt_from_training_rows(spark, documents, labelled):
    docs = documents([(i, t) for i, t, _ in labelled])
    labels = spark.createDataFrame([(i, 0, x) for i, _, x in labelled if i % 3] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digests(docs, labels).collect()}
    want = {i: x for i, _, x in labelled}
    assert len(got) == len(want) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert 250 < len(held) < 500
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark, documents, labelled):
    docs = documents([(i, t) for i, t, _ in labelled[:400]])
    labels = spark.createDataFrame([(i, 0, x) for i, _, x in labelled[:400]], "doc_id long, quality int, toxic int")
    lies = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["when"]).when(
        toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.digests(docs, x).collect()) for x in (labels, lies)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_texts_and_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.digests(documents(ODD), none).collect()
    assert len(got) == len(ODD) and {round(r.score, 6) for r in got} == {0.5}
    assert toxicity.digests(documents([]), none).count() == 0
    model = toxicity.Model(np.array([3]), np.array([1.0]), -2.0)
    assert [r.score for r in toxicity.score(documents([(1, None), (2, "")]), model).collect()] == [1 / (1 + np.exp(2.0))] * 2


def test_cross_entropy_difference_by_hand(spark, documents):
    from collections import Counter
    rows = [(k, f"good words here number n{k % 5}" if k % 3 == 0 else f"bad things there x{k % 7} bad") for k in range(60)] + [(70, None), (71, "")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in crossentropy.score(documents(rows), labels).collect()}
    count = Counter(w for _, t in rows for w in brute.plain_words(t))
    seen = {w for w, n in count.items() if n >= crossentropy.MIN_COUNT}
    lines = {i: ["<s>", *(w if w in seen else "<u>" for w in brute.plain_words(t))] for i, t in rows}
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in lines.items():
        for m in ([0, 1] if i < 60 and i % 3 == 0 else [1]):
            one[m].update(w if len(w) > 1 else [])
            two[m].update(zip(w, w[1:]))
    n = [sum(c for w, c in one[m].items() if w != "<s>") for m in (0, 1)]
    scale = [1.0, n[0] / n[1]]
    for i, w in lines.items():
        for m, name in enumerate(("loss_target", "loss_background")):
            s, total = scale[m], scale[m] * n[m]
            loss = [-np.log(0.6 * min(1, (s * two[m][a, b] + 1) / (s * one[m][a] + crossentropy.BIGRAMS / crossentropy.VOCABULARY + 1))
                            + 0.4 * (s * one[m][b] + 1) / (total + crossentropy.VOCABULARY)) for a, b in zip(w, w[1:])]
            assert got[i][name] == pytest.approx(np.mean(loss) if loss else 0, abs=1e-9), (i, name)
    assert min(got[k].score for k in range(0, 60, 3)) > max(got[k].score for k in range(60) if k % 3)


def test_cross_entropy_of_odd_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = crossentropy.score(documents(ODD), none).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) for r in got)
    assert crossentropy.score(documents([]), none).count() == 0


@pytest.mark.parametrize("hot", [1 << 16, 4])
def test_cross_entropy_counts_every_word_and_bigram(spark, documents, monkeypatch, hot):
    from collections import Counter
    monkeypatch.setattr(crossentropy, "VOCABULARY", 16)     # far fewer than there are words and bigrams
    monkeypatch.setattr(crossentropy, "BIGRAMS", 64)
    for name in ("HOT", "HOT_PAIRS"):
        monkeypatch.setattr(crossentropy, name, hot, raising=False)
    monkeypatch.setattr(crossentropy, "BUCKET", 500, raising=False)
    r = random.Random(9)
    rows = [(k, " ".join("the" if r.random() < 0.4 else f"w{int(r.paretovariate(0.5)) % 3000}" for _ in range(r.randint(1, 60)))) for k in range(200)]
    rows += [(300, "alone"), (301, None), (7, rows[7][1]), (None, "the the")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    count = Counter(w for _, t in rows for w in brute.plain_words(t))
    seen = {w for w, n in count.items() if n >= crossentropy.MIN_COUNT}
    one, two, n, lines = [Counter(), Counter()], [Counter(), Counter()], [0, 0], []
    for i, t in rows:
        w = ["<s>", *(w if w in seen else "<u>" for w in brute.plain_words(t))]
        lines.append((i, w))
        for m in ([0, 1] if i is not None and i < 200 and i % 3 == 0 else [1]):
            one[m].update(w if len(w) > 1 else [])
            two[m].update(zip(w, w[1:]))
            n[m] += len(w) - 1
    scale, size, want = [1.0, n[0] / n[1]], max(16, len(seen) + 1), []
    for i, w in lines:
        loss = [[-np.log(0.6 * min(1, (s * two[m][a, b] + 1) / (s * one[m][a] + 64 / 16 + 1)) + 0.4 * (s * one[m][b] + 1) / (s * n[m] + size))
                 for a, b in zip(w, w[1:])] for m, s in enumerate(scale)]
        want.append((-1 if i is None else i, len(w) - 1, *(np.mean(x) if x else 0 for x in loss)))
    got = [(-1 if x.doc_id is None else x.doc_id, x.n_words, x.loss_target, x.loss_background) for x in crossentropy.score(documents(rows), labels).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-9)
