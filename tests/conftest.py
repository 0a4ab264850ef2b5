import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folioquery.session import local_session

    s = local_session(4, 4)
    from folioquery.plans.ship import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def read(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
