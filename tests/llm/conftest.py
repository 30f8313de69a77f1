from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, ids string, n_lines int, _host string, lang_pred string, kept boolean, elements string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"word{k % 977} tail{k}" for k in range(40_000))
    rows = [
        (1, "the same text of some words here\nline two", "en", "a"), (2, "the same text of some words here\nline two", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "   \n\t ", "fr", None),
        (6, long, "en", "a"), (7, long, "en", "b"), (8, "x", "de", "b"), (8, "x", "de", "b"), (None, "no id here", "en", "a"), (9, "naïve café 漢字 \U0001f600 ß", "fr", "c"), (10, "1234 5678 !!", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", "i", 1, "h", "q", True, "e") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
