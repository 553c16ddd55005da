"""Running a query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def shown(x) -> str:
    return f"{x:.9g}" if isinstance(x, float) else "null" if x is None or x is pd.NaT else str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    whole = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(shown(float(x) if isinstance(x, float) else x) for x in r) for r in whole.itertuples(index=False))


def same(spark, run, sql: str, folder: str) -> None:
    got, want = run(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
