import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("FACTFOLD_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factfold.session import build_session

    session = build_session("factfold-tests", cpus=8, shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return session
