import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from turnstile.session import build_session
    # A zone with clock changes: results must not depend on it.
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.sql.session.timeZone": "America/New_York"})
    yield s
    s.stop()
