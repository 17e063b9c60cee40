"""The registered queries of operators 3, 11 and 12 against their SQL on the driver's smallest tables."""

import os

import compare
import pytest

from lotlens.llm import queries

FOLDER = os.environ.get("LOTLENS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op3_licences", "op11_hard_negatives", "op12_spelling_variants"])
def test_matches_sql(spark, name):
    assert compare.diff(queries.QUERIES[name](spark, FOLDER), compare.connect(FOLDER), queries.ORACLES[name]) is None


def test_line_quality_scores_every_document(spark):
    rows = queries.QUERIES["op13_line_quality"](spark, FOLDER).collect()
    with_docs = compare.connect(FOLDER).execute("select count(*), count(*) filter (text is null) from documents").fetchone()
    assert len(rows) == with_docs[0] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_packing_alone_remembers_more_runs_than_beside_other_stages(spark, monkeypatch):
    from lotlens.llm import packing, queries, stages, tokens

    asked, real = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **more: asked.append(more.get("remembered")) or real(docs, **more))
    assert queries.QUERIES["op4_best_fit_packing"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked[0] > tokens.GENERATION > stages.REMEMBERED
