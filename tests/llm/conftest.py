import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, size string, n long, ids int, component string, _row int"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


def hard_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, extra columns."""
    extra = (1, "x", 2, 3, "c", 4)
    rows = [
        (1, prose(1, 60), "en", "b", 5, *extra),
        (2, prose(1, 60), "en", "a", 5, *extra),
        (3, prose(1, 59) + " changed", "en", "b", 5, *extra),
        (4, prose(2, 30) + "\n" + prose(3, 30), "en", "b", 5, *extra),
        (4, prose(2, 30) + "\n" + prose(3, 30), "en", "b", 5, *extra),
        (5, None, "en", "a", None, *extra),
        (6, "", "en", "a", 0, *extra),
        (7, " \n\t ", "en", None, 3, *extra),
        (8, "Two words", None, None, 9, *extra),
        (9, "two WORDS", None, None, 9, *extra),
        (None, prose(5, 40), "en", "b", 5, None, None, None, None, None, None),
        (10, prose(6, 4000), "de", "c", 5, *extra),
        (11, "Ünï cödé  double  spaces\u00a0here 東京 東京\r\n\r\nthe end 🚚 it's", "fr", "c", 5, *extra),
        (12, "x" * 3000, "en", "c", 5, *extra),
        (13, "\n".join(["same line here"] * 8), "en", "c", 5, *extra),
    ]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
