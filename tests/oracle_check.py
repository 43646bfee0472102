"""Run registered queries beside their SQL: python tests/oracle_check.py [sf_dir] [name part …]"""

from __future__ import annotations

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def sorted_rows(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in place], sorted((tuple(plain(r[i]) for i in place) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, (bool, list)) else (False, "", str(v)) for v in r])


def compare(con, spark_df, sql: str) -> str:
    cursor = con.execute(sql)
    want_cols, want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    got_cols, got = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} want {want_cols}"
    if len(want) != len(got):
        return f"rows {len(got)} want {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first: got {wrong[0][0]} want {wrong[0][1]}"
    types = {(type(a).__name__, type(b).__name__) for g, w in zip(got, want) for a, b in zip(g, w) if type(a) is not type(b)}
    return f"ok {len(got)} rows" + (f" (types {types})" if types else "")


def main() -> None:
    from tidegauge.session import get_spark

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    if wanted and wanted[0].startswith("module:"):
        modules = [importlib.import_module(f"tidegauge.workload.{wanted[0][7:]}")]
        wanted = wanted[1:]
        queries = {k: v for m in modules for k, v in m.QUERIES.items()}
        oracles = {k: v for m in modules for k, v in m.ORACLES.items()}
    else:
        import __spark_entry__ as entry

        queries, oracles = entry.queries(), entry.oracle_sql()
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("FATAL")
    con = connection(sf_dir)
    bad, began = 0, time.time()
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            result = compare(con, frame, oracles[name]) if name in oracles else f"rows only {frame.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = result.startswith(("ok", "rows only"))
        bad += not ok
        print(f"{'   ' if ok else '!! '}{name:34s} {time.time() - start:6.1f}s {result}", flush=True)
    print(f"{bad} bad, {time.time() - began:.0f}s")


if __name__ == "__main__":
    main()
