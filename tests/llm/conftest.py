import pytest

#: Rows every operator has to take: nulls, blanks, a very long text, ties, repeated rows, clashing columns.
EDGE = [
    (1, None, "en", None), (2, "", None, "a"), (3, "  \n ", "en", "a"), (4, "one", "en", "b"),
    (5, "the cat sat on the mat and the dog ran\n" * 3000, "en", "b"),
    (6, "same text here for both of us and more", "en", None), (7, "same text here for both of us and more", "de", "a"),
    (8, "twice the same row", "en", "a"), (8, "twice the same row", "en", "a"), (None, "no id at all", "en", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Extra columns have names that operators use inside."""
    rows = [(*r, 1, "x", 2, [3]) for r in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, h long, key string, copies int, spans array<int>")
