import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import SF  # noqa: E402


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of the smallest size, with odd rows: null, empty, blank, repeated, one long."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "one two"), (10_004, "one  two"), (10_005, rows[3][1]), (10_006, " ".join(t for _, t in rows[:40])), (10_007, rows[5][1] + " more words at its end")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in corpus], "doc_id long, text string, ids string, row long, spans binary").repartition(3)
