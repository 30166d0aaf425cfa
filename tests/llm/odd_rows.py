"""Documents with everything that may be odd in a row, and fixtures of them."""

import pytest

from growthgrain.session import shared_folder

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "chunk string, row int, size string, range int, bucket string, fp int, kept_id int"
)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: doc_id, text, lang, source
ODD = [
    (1, "The cat sat on the mat and looked at the dog by the door.", "en", "a"),
    (2, "the CAT sat on the mat and looked at the dog by the door.", "en", "b"),
    (2, "the CAT sat on the mat and looked at the dog by the door.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "de", "b"),
    (None, "no number here but quite a few words in the text all the same", "en", None),
    (6, LONG, "en", "a"),
    (7, f"before it {PASSAGE} after it", "en", "a"),
    (8, f"{PASSAGE} ends elsewhere in another way", "en", "ü"),
    (None, f"also {PASSAGE}", "en", "b"),
    (9, "größe straße über für und nicht die der das ist ein 梦 x", "de", "b"),
    (10, "x", "fr", "a"),
    (11, "1234 5678", "fr", "b"),
    (12, "line one is here\nline one is here\nline one is here\n\n\nother", "en", "a"),
    (13, "again " * 40, "en", "b"),
    (14, "y" * 500 + " " + "z" * 70, "es", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*row, len(row[1] or ""), "c", 7, "s", 1, "b", 5, 9) for row in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    return shared_folder(spark)
