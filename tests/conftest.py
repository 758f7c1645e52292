import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marketlens.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="marketlens-test-ckpt-")
    s = get_spark("local[4]", app="marketlens-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt,
                         "spark.sql.streaming.forceDeleteTempCheckpointLocation": "true"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="marketlens-test-")
