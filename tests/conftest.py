import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = os.environ.get("PAIRLAB_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pairlab.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pairlab-test-ckpt-")})
    yield s


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="pairlab-test-")
