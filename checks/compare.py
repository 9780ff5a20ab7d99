"""Run the queries on Spark and their twins on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import CHECKS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty if both engines agree, else what differs."""
    check = CHECKS[name]
    df = check.query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if check.oracle is None:
        return "" if got else "no rows"
    found = con.execute(check.oracle)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = _rows(names, found.fetchall())
    if got == want:
        return "" if got else "no rows on either side"
    first = lambda c: next(iter(c.items()), None)
    return (
        f"{got.total()} rows against {want.total()}, columns {sorted(names)}, "
        f"only Spark {first(got - want)}, only DuckDB {first(want - got)}"
    )


def main() -> None:
    from loadgauge.session import SETTINGS

    sf_dir = sys.argv[1]
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8"}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or CHECKS:
        start = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name) or "ok"
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name} {time.time() - start:.2f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
