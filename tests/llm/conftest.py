import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and a column with a clashing name."""
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [
        (0, None, "a"), (1, "", "b"), (2, "  \n\t ", None), (3, long, "c"), (4, "The quick brown fox jumps over the lazy dog again and again", "d"), (4, "The quick brown fox jumps over the lazy dog again and again", "d"),
        (5, "THE QUICK brown fox jumps over the lazy dog again and again", "e"), (None, "no id but words in a row", "f"), (6, "x" * 50_000, "g"), (7, "é è ü 　   中文 👍🏽 token = abcdef12 <|endoftext|> end", "h"), (8, "one two", "i"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, mark string")
