"""Tables of odd rows that every operator must take."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null id, null and empty and blank text, ties, a repeated row, a very long text, clashing column names."""
    prose = " ".join(WORDS)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, prose, "en"), (5, prose, "fr"), (5, prose, "fr"),
        (6, prose + " end", "en"), (None, prose, "en"), (None, None, None), (7, "x", "de"),
        (8, "\n".join(f"line {i} of the long text {i * i}" for i in range(30_000)), "en"),
        (9, "a b c\na b c\n\nd e f\na b c", "en"), (10, "#" * 5000, "en"),
    ]
    return spark.createDataFrame([r + ("src", 0, True, 9) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
