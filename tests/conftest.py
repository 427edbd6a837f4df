import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle  # noqa: E402

import pairloom  # noqa: E402
from pairloom.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(pairloom)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect


EDGE_TEXTS = [None, "", " ", "\n\t", " ", "　", "\u001c", "\U0001f600 ok", "None", "a|||b", "{braces}",
              "<think>a</think>", "<|im_end|>", " padded "]
