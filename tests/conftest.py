import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from engagelake.config import LakeConfig  # noqa: E402
from engagelake.session import get_spark  # noqa: E402
from engagelake.sources.lake import Lake  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("engagelake-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, LakeConfig(data_root=str(tmp_path / "lake")))
