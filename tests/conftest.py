import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from stratalith.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
