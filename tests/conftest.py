import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    s = local_session(cores=8, partitions=8, checkpoints=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
