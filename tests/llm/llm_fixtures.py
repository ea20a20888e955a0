"""Documents for the tests of the llm subpackage."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, kind int, text_a string, `class` string, n_entities int"


def docs_of(spark, texts, langs=None):
    """Documents with extra columns whose names clash with internal ones."""
    rows = [(i, t, (langs or {}).get(i), f"src{i % 3}", len(t or ""), "x", 1, "y", "z", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = "the river bank holds many small boats and old nets while gulls circle above the quiet harbour every morning before light".split()


def prose(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + ("" if i % 3 else str(k)) for i in range(n))
