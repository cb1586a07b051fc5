from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) pairs, with columns that clash with names the operators use inside."""
    def make(rows):
        frame = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, bucket string, n_words long")
        return frame.repartition(3)
    return make
