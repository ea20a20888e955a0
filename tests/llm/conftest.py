import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import SCHEMA, docs_of, prose  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, copies, near copies, ties, odd scripts, and one very long text."""
    base = [prose(k, 40 + k) for k in range(12)]
    near = [base[0] + " extra words", base[0].replace("harbour", "haven", 1), " ".join(base[1].split()[1:])]
    return [None, "", "  \n\t ", *base, base[2], base[2].upper(), base[2], *near, "one two", "ONE two", "日本語 のテキスト です", "Привет мир, как дела", "x", prose(99, 4000), "á \U0001f600 Kİ", "<|endoftext|> it's"]


@pytest.fixture
def docs(spark, texts):
    return docs_of(spark, texts)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
