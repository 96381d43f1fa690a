import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabsight.session import local_session

    tmp = tempfile.mkdtemp(prefix="tabsight-tests-")
    s = local_session(cores="*", shuffle_partitions=8, app="tabsight-tests")
    s.sparkContext.setCheckpointDir(tmp)
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
