import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from orderlens.session import local_session

    ckpt = tempfile.mkdtemp(prefix="orderlens-test-ckpt-")
    s = local_session(cores="*", shuffle_partitions=8, app="orderlens-tests", checkpoint_dir=ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from orderlens.verify import duckdb_con

    return duckdb_con(SF_SMALL)
