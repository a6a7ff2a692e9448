import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, white space, copies, near copies, long texts, clashing extra columns."""
    prose = " ".join(f"word{i % 37} thing{i % 11}" for i in range(400))
    near = prose + " and a little more at the end"
    rows = [
        (0, prose, "en", "a"), (1, prose, "en", "a"), (2, near, "en", None), (3, None, None, "a"), (4, "", "en", "b"),
        (5, "one", "en", "b"), (6, "one", "de", "b"), (7, "Two words\x0b\t", "de", "b"), (8, "  lead  and trail \n\n x  ", "de", "a"),
        (9, "<|endoftext|> é中 it's </s>", "fr", "c"), (10, "x" * 30_000, "fr", "c"), (11, "a b " * 9_000, None, "c"),
        (None, "no key at all", "en", "a"), (12, "12 34 !!", "en", None), (12, "12 34 !!", "en", None),
    ]
    table = [(*r, 1, 0.5, "fp") for r in rows]
    return spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, rank int, score double, fingerprint string")
