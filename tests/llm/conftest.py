import pytest

ODD = [
    (None, "words of a row without an id that are long enough to be kept by the rule"),
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (7, "Alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (8, "word " * 30_000), (9, "x" * 200_000), (10, "a b c d e f g h i j\na b c d e f g h i j\n\n \nlast line"),
    (11, "été à la plage   straße naïve 東京 1 2 3 4 5 6 7 8 9"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with the operators' own names."""
    rows = [(i, t, None if i in (4, 9) else "en", None if i in (5, 9) else "s1", 0, "x", -1, 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, g string, n_words int, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id > 1000")
