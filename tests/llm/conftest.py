import pytest

#: Documents with every odd case: nulls, blanks, repeated rows, long texts.
PASSAGE = " ".join(f"word{i}" for i in range(60))


def documents(spark, rows, extra=True):
    """(doc_id, text) rows, with other columns whose names clash with results."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' AS score", "1 AS ids", "2 AS n", "3 AS row", "4 AS id", "5 AS kept",
                           "6 AS component_id", "'y' AS key", "7 AS N_WORDS", "8 AS secrets", "9 AS language")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    long_text = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    return [
        (1, PASSAGE + " alpha beta"), (2, "gamma " + PASSAGE), (3, None), (4, ""), (5, "   \t\n "), (6, "short"),
        (7, long_text), (8, long_text[:100_000] + " changed here and there"), (9, "naïve café ÄÖÜ 東京 \U0001F600 tail"),
        (10, PASSAGE + " alpha beta"), (11, "a" * 5000), (12, "spam " * 3000), (6, "short"), (None, "no id here"),
        (None, None), (13, " odd blank\x0bs"),
    ]
