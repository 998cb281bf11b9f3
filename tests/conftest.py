import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf):
    """Rows of a query and of its SQL, comparable."""
    import glob

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def plain(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return ""
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def both(df, sql):
        a, b = df.toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda t: sorted((tuple(plain(v) for v in r) for r in t[sorted(a.columns)].astype(object).values.tolist()), key=str)
        return rows(a), rows(b)

    return both
