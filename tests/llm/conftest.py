import pytest

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog. " * 6, "en"), (2, "The quick brown fox jumps over the lazy dog. " * 6, "en"), (3, None, None), (4, "", "en"), (5, "one", "de"),
    (6, "  odd \n\n white\tspace  é漢😀  ", None), (7, "x " * 30_000, "en"), (8, "long" * 5_000, "en"), (1, "The quick brown fox jumps over the lazy dog. " * 6, "en"), (None, "no id here at all", "fr"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame([(i, t, g, *range(9), "k") for i, t, g in EDGES], "doc_id long, text string, lang string, node long, row long, tag long, mark long, key long, found long, first long, _has long, hit long, p string")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.filter("false")
