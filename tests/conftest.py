import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shoppulse.session import get_session
    s = get_session("local[*]", 8, extra={
        # tests set their own checkpoint folder (a cluster names a shared one)
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shoppulse-test-ckpt-"),
    })
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="shoppulse-test-")
