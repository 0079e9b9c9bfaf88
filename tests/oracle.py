"""Holds queries against their SQL on one data folder, as multisets of rows by sorted column names."""

from __future__ import annotations

import datetime
import decimal
import sys
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def kind(v) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def plain(v):
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def compare(spark, con, run, sql: str, sf_dir: str) -> str:
    """Empty, or what differs."""
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} against {len(want)} rows; only ours {a}; only SQL {b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    con = connect(sf)
    only, sqls, bad = sys.argv[2:], entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if name in sqls and (not only or any(name.startswith(o) for o in only)):
            try:
                said = compare(spark, con, run, sqls[name], sf)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:600]}"
            if said:
                bad += 1
                print(name, said, flush=True)
    print("checked", len(sqls), "bad", bad)
