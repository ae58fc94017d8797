import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from conftest_llm import DOCS, documents  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
