"""Documents with what can go wrong in them."""

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
# doc_id, text, lang, source; ids and texts repeat, ties and nulls everywhere.
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, "a"), (4, "one", "de", None), (5, "one two", None, None),
    (6, "A bé ß \U0001f600 ć 　x y <|endoftext|>z", "fr", "b"), (7, LONG, "en", "b"), (8, LONG, "en", "b"),
    (8, LONG, "en", "b"), (9, f"start {PASSAGE} end", "en", "c"), (10, f"other {PASSAGE}  tail\n\ntail", "en", "c"),
    (11, "und " * 400, "de", "c"), (12, "x" * 20_000, "en", "\U0001f600"), (None, "no id here", "en", "c"), (None, None, None, None),
    (13, "same line\nsame line\n\nother | # line", "en", "c"), (14, "tie tie tie tie tie tie", "en", "d"), (15, "tie tie tie tie tie tie", "en", "d"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The documents above with columns whose names operators use themselves."""
    rows = [(*r, None if r[1] is None else len(r[1]), *[f"mine{i}"] * 12) for i, r in enumerate(EDGE)]
    clash = "row string, size string, score string, key string, kept string, n_words string, words_key string, unit string, slice string, label string, print string, words string"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + clash)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
