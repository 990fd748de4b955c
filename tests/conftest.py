import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tideloom.session import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                    spark__checkpoint__dir=str(tmp_path_factory.mktemp("ckpt")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
