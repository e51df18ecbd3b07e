import pytest

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and long texts, repeated rows, and clashing extra columns."""
    line = "a line of text that is long enough to count"
    rows = [
        (1, "plain words here", "en", "s1", 0),
        (1, "plain words here", "en", "s1", 0),
        (2, None, None, None, 0),
        (3, "", "en", "s1", 0),
        (4, LONG, "en", "s2", 0),
        (5, f"{LONG} and some more", "en", "s2", 0),
        (None, line, None, "s2", 0),
        (6, f"{line}\nsix stays\n{line.upper()}  ", "de", None, 0),
        (7, f"\t{line}\nseven stays", "de", "s3", 0),
        (8, f"{line}\r\neight stays", "de", "s3", 0),
        (9, f"nine begins. {PASSAGE} nine ends", "en", "s1", 0),
        (10, f"ten is other. {PASSAGE} ten ends too", "en", "s1", 0),
        (11, " \n\t \r\n", "en", "s1", 0),
        (12, "É  x <|im_end|> İ @ + 1.2.3.4 a@b.co", "fr", "s1", 0),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_words bigint"
    ).withColumnsRenamed({"n_words": "keys"})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -5")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def some_texts(documents):
    """Texts to hold small functions against."""
    return [row.text for row in documents.orderBy("doc_id").limit(40).collect()]
