import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples in the order of the named columns."""

    def collect(df, *columns):
        return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=lambda t: tuple((v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in t))

    return collect
