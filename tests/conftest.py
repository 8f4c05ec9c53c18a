import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(4, partitions=4, **{"spark.sql.streaming.stateStore.maintenanceInterval": "600s", "spark.default.parallelism": "4"})


@pytest.fixture(scope="session")
def data():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
