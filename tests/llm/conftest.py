import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, size int, part string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text[, lang[, source]]) rows, with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)))[:4] + (0, 1, 2, "x") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empties, a very long text, ties, repeated rows, a null id and one id with two texts."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog again and again until night"
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, plain), (5, plain), (5, plain), (6, plain + " x"), (7, long),
        (8, "a b"), (8, "something else entirely is said here by nobody"), (None, plain), (9, "!!! ??? 123"), (10, "É é ŒUVRE straße"),
    ]
