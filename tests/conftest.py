import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cladeworks.session import build  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a folder."""
    import duckdb

    def run(sql: str, folder: str):
        c = duckdb.connect()
        for f in os.listdir(folder):
            name = f.removesuffix(".parquet")
            path = f"{folder}/{f}" + "/*.parquet" * os.path.isdir(f"{folder}/{f}")
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        return c.execute(sql).fetch_df()

    return run


def _cell(v):
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "O") in "iuf" else str(v)


def rows(frame):
    """Rows of a pandas frame in a form that can be compared, whatever their order."""
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_cell, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)
