import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing extra columns."""
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "   ", "en", None), (4, "the cat sat on the mat again and again today", "en", "y"),
            (4, "the cat sat on the mat again and again today", "en", "y"), (5, "the cat sat on the mat again and again today", "en", "y"),
            (None, "the cat sat on the mat again and again today", "en", "z"), (6, "12345 !!! 678", "de", "z"),
            (7, "le chat est sur le tapis rouge " * 3000, "fr", "z"), (8, "x" * 50_000, None, "z"), (9, "é\x01\x02ü 日本語 😀 token", "en", "z")]
    schema = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(rows, schema).selectExpr(
        "*", "length(text) as n_chars", "'c' as cid", "'g' as token", "1 as n", "'b' as blob", "2 as score", "'s' as shard")
    return frame


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def queries():
    return entry.queries()
