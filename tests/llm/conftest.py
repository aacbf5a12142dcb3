import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session


# doc_id, text: nulls, blanks, short, long, tied and repeated rows.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "One two three."), (6, "one TWO three."), (7, "été 日本語 😀 ́"),
        (8, "word " * 40_000), (9, "x" * 50_000), (10, "Same text here, said twice over.\n" * 3),
        (11, "Same text here, said twice over.\n" * 3), (12, "Repeated row."), (12, "Repeated row."), (None, "no id at all"),
        (-5, "<|endoftext|> 's \x00\x01 .!?")]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 0.5, "r", 7) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, row string, n long")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")
