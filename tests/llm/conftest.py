import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from clinspark.llm.text import tuned  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
GOOD = "The river was low in spring, and the boats lay on the bank until the rain came back in June."
ODD = [
    (0, GOOD), (1, GOOD), (2, GOOD + " Then they left."), (3, ""), (4, None), (5, " \n\t "), (6, "one"), (None, GOOD),
    (7, "!!! ??? ***"), (8, "x" * 30000), (9, "İstanbul ΣΑΣ naïve café \x1c end <|endoftext|> don't 12"), (9, "one"),
    (10, "<|ENDOFTEXT|> THE  End.\n\n\nnext line  "), (11, "日本語 のテキスト ١٢"), (12, "a b c d e " * 400),
]


@pytest.fixture(scope="session")
def llm(spark):
    return tuned(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Null, empty, blank, repeated, very long and odd texts, with extra columns whose names clash with results."""
    return llm.createDataFrame([(i, t, None, None, None, 0.5, "x") for i, t in ODD], DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCUMENTS)
