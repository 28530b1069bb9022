"""Runs registered queries and their SQL twins side by side.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _kinds(frame: pd.DataFrame) -> dict[str, str]:
    names = {"int32": "int", "int64": "int", "Int64": "int", "float64": "float", "object": "text", "str": "text"}
    kinds = {c: names.get(str(t), str(t)) for c, t in sorted(frame.dtypes.items())}
    # whole numbers with nulls among them come as floats
    whole = {c for c, kind in kinds.items() if kind == "float" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all()}
    return {c: "int" if c in whole else kind for c, kind in kinds.items()}


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = _canonical(left), _canonical(right)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows, first {str(wrong[0])[:600]}"
    if len(left) and _kinds(left) != _kinds(right):
        return f"types {_kinds(left)} / {_kinds(right)}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from civiltext.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir).toPandas()
            spent = time.time() - start
            note = "rows only"
            if name in sql:
                middle = time.time()
                expected = con.execute(sql[name]).df()
                note = difference(frame, expected)
                note = f"MISMATCH {note}" if note else f"ok  sql {time.time() - middle:.1f}s"
        except Exception as error:  # report and go on with the next query
            spent, note = time.time() - start, f"ERROR {type(error).__name__}: {str(error)[:700]}"
            frame = pd.DataFrame()
        bad += note.startswith(("MISMATCH", "ERROR"))
        print(f"{name:32s} {len(frame):7d} rows {spent:6.1f}s  {note}", flush=True)
    print(f"{bad} problem(s)")


if __name__ == "__main__":
    main()
