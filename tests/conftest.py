import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeloom.session import local_session, scratch_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8)
    yield s


@pytest.fixture
def tmp_root(spark):
    return scratch_dir(spark, "test")


@pytest.fixture
def tmp_root_factory(spark):
    """Fresh folder per call (hypothesis runs many examples in one test)."""
    return lambda: scratch_dir(spark, "test")


def write_json(path: str, records) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(records if isinstance(records, str) else json.dumps(records, indent=2))
    return path


def _event(n: int, minute: int, **changes):
    """A valid record; a change to ``...`` leaves the key out."""
    record = {"event_id": f"click-{n}", "user_id": f"visitor-{n % 3}", "account_id": f"tenant-{n % 2}",
              "event_timestamp": f"2026-03-14T{20 + n // 10}:{minute:02d}:30Z", "page_name": ["search", "cart", "help"][n % 3],
              "session_id": f"sess{n}", "properties": {"module": "shop"}}
    return {k: v for k, v in {**record, **changes}.items() if v is not ...}


# The first file: two valid records and one whose user is JSON null. The second: four
# valid ones (one sent twice, one again from the first file) and one record for each
# way to break the contract.
FILE_A = [_event(1, 5, properties={"browser": "Lynx", "duration_ms": 77}), _event(2, 6, user_id=None), _event(3, 7)]
FILE_B = [_event(11, 1), _event(12, 2), _event(11, 1), _event(3, 9), _event(14, 3, event_id=...), _event(15, 4, account_id=...),
          _event(16, 5, event_timestamp=...), _event(17, 6, user_id=None), _event(18, 7, account_id="")]
F_A = "dt=2026-03-14/hr=20/clicks_a.json"
F_B = "dt=2026-03-14/hr=21/clicks_b.json"


@pytest.fixture
def sample_landing(tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/{F_A}", FILE_A)
    write_json(f"{root}/{F_B}", FILE_B)
    return root
