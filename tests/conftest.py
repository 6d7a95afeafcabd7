import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tokloom.session import build_session
    s = build_session("local[4]", app="tokloom-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    # Tests set their own checkpoint folder: nothing is configured locally.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tokloom-test-ckpt-"))
    yield s
    s.stop()
