import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text and columns whose names the operators use themselves."""
    def make(rows, more=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if more:
            df = df.selectExpr("*", "1 as score", "'x' as _h", "'y' as spans", "'z' as words", "doc_id as k_doc", "'q' as row",
                               "'t' as target", "array(1) as rare", "true as found", "'u' as licences", "2 as sentence_ids", "'v' as toxic",
                               "'w' as n_words", "'s' as set_id", "'h' as h", "3.5 as n", "'r' as root", "'k' as start", "'o' as class_id")
        return df
    return make
