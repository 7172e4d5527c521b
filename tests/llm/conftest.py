import pytest

#: Edge cases every operator on documents has to take: nulls, empty and long texts, repeats, clashing columns.
EDGES = [
    (1, "A b c d e f g h i j k l", "en", "x", 7),
    (1, "A b c d e f g h i j k l", "en", "x", 7),
    (2, "a b c d e f g h i j k l", None, None, None),
    (3, None, "en", "x", 0),
    (4, "", "en", "x", 0),
    (None, "a b c d e f g h i j k l m", "en", "x", 1),
    (5, " \n\t \x0b", "en", "x", 1),
    (6, "one two", "en", "x", 1),
    (7, "ONE\ntwo", "en", "x", 1),
    (8, "é ß 漢字 🙂 " * 40, "de", "x", 1),
    (9, "word " * 30_000, "en", "x", 1),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key string, digest int, label string"
    return spark.createDataFrame([(*row, 0.5, "yes", "k", 1, "l") for row in EDGES], kinds)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
