import pytest

LONG = "Word after word of one very long line, " * 4000
PROSE = ("The old mill stood by the river and the miller walked along the bank every morning before the sun was up. " "Nobody in the village knew how long he had lived there, and nobody asked.")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and columns with awkward names."""
    rows = [
        (1, "Plain text with a few words in it.", "en", "a"), (2, None, "en", "a"), (3, "", "de", None), (None, "A text without an id.", None, "b"), (None, None, None, None),
        (4, LONG, "en", "b"), (5, "  \t\n ", "en", "b"), (6, PROSE, "en", "a"), (6, PROSE, "en", "a"), (7, PROSE, "fr", "b"), (8, "12345 --- !!!", "de", "b"), (9, "naïve Ünïcode 🙂 text with İ and ß", None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as long) as n_chars", "'x' as score", "'y' as copy", "'z' as row", "'w' as body", "'v' as removed").persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
