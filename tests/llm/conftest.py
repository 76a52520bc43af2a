import pytest

LONG = " ".join(f"word{k % 7919} and" for k in range(60_000)) + "."
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, ids int, start int, kept int, class_id int, "
          "text_hash int, pii_kinds int, h int, w int, s int, at int, clean_text int, leaves int, key int, band int")


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows, one id with two texts; further columns of any name."""
    passage = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest today."
    rows = [
        (1, passage, "en", "a"), (1, passage, "en", "a"), (2, passage + " Indeed", "en", "a"), (3, None, None, None),
        (4, "", "en", "a"), (5, "   \n\t ", "de", None), (None, passage, None, "b"), (6, LONG, "en", "a"),
        (7, "one two", "fr", "a"), (7, "one three four five six seven eight nine ten eleven twelve.", "fr", "a"),
        (8, "Ünï çödé wörds hier, für die Prüfung. Σας 你好 x² <|endoftext|>", "de", "c"), (None, None, None, None),
    ]
    return [(*r, len(r[1] or ""), *range(14)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
