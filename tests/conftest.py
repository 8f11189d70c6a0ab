import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandline.session import local_session

    s = local_session(4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(table):
    """Rows of an Arrow table as sorted tuples of text, columns by name."""
    names = sorted(table.column_names)
    text = lambda v: "~" if v is None or v != v else str(v)
    return sorted(tuple(text(r[n]) for n in names) for r in table.to_pylist())
