import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from orderlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        8,
        shuffle_partitions=4,
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.sql.maxMetadataValueLength": "10000",
        },
    )
    yield session
    session.stop()
