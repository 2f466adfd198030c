import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rows import SCHEMA, document  # noqa: E402


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    prose = " ".join(f"word{i * 7919 % 613} of{i % 5}" for i in range(60))
    rows = [
        document(1, prose),
        document(2, prose.replace(" ", "\n\t ")),
        document(3, None),
        document(4, ""),
        document(5, " \t\n\x0b\x0c\r "),
        document(6, "a b"),
        document(7, "long " * 30000 + "\n" + "end"),
        document(8, prose, source=None, lang=None),
        document(None, "nobody's text"),
        document(None, None, source=None, lang=None),
        document(9, "twice the same row"),
        document(9, "twice the same row"),
        document(10, "same id, one text"),
        document(10, "same id, another text"),
        document(11, "café   \U0001f600 \\ <|im_end|> ### done."),
        document(-5, prose + " more"),
    ]
    return spark.createDataFrame(rows, SCHEMA)
