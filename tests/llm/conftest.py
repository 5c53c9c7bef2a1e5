from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text[, source]) rows, with columns that clash with helper names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1.5) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, score string, size double")

    return make
