from __future__ import annotations

import pytest

from strataquery.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 2, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))) if not s.conf.get("spark.checkpoint.dir", None) else None
    yield s
    s.stop()
