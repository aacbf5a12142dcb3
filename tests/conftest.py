import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


# Strings every encoder must cope with.
EDGE = [None, "", " ", "a", "  lead", "trail  ", "two   spaces", "line\nbreak", "UPPER Case", "élan vital", "日本語 テキスト",
        "emoji 😀😁", "ab", "common", "common", "common", "once"]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(i, s, float(i % 3)) for i, s in enumerate(EDGE)], "id int, s string, y double")
