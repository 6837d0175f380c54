import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textpulse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    rows = [
        (0, "", "a"),
        (1, "Running", "a"),
        (2, "the cat and the Dog, the end", "b"),
        (3, "internationalisation of straightforwardness", "b"),
        (4, "dog cat dog", "a"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")
