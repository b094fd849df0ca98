from __future__ import annotations

import pytest
from llm_texts import BODY, OTHER
from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"long{i % 997} part{i}" for i in range(60_000))
    rows = [
        (1, BODY, "en", "a", len(BODY)),
        (1, BODY, "en", "a", len(BODY)),
        (2, BODY.replace("item50 ", "changed "), "en", "a", 1),
        (3, OTHER, None, None, None),
        (4, OTHER, "en", "a", 2),
        (5, None, "en", "a", 3),
        (6, "", "en", "a", 0),
        (7, "one", "en", "a", 3),
        (8, "one", "en", "a", 3),
        (9, " \t\n ", "en", "a", 4),
        (None, BODY, "en", "a", 5),
        (None, None, None, None, None),
        (10, long_text, "en", "a", len(long_text)),
        (11, "x" * 100_000 + " " + "9" * 50_000 + "." * 1_000, "en", "a", 9),
        (12, "mail joe@example.org or joe (at) example [dot] org ▁x  two  spaces\n", "en", "a", 9),
        (13, "All rights reserved. Licensed under CC BY-NC 4.0.", "en", "a", 9),
    ]
    frame = spark.createDataFrame(rows, DOCUMENT)
    for name in ("ids", "spans", "leaks", "p_toxicity", "label", "key", "node", "score", "kept", "ranges", "decoded"):
        frame = frame.selectExpr("*", f"'extra' AS {name}")
    return frame


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 14)] + [(1, 0, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, T.StructType().add("doc_id", T.LongType()).add("quality", T.IntegerType()).add("toxic", T.IntegerType()))
