import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from duoscope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark_sql_shuffle_partitions="4", spark_driver_memory="6g", spark_ui_enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
