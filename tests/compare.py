"""Run queries against their SQL on DuckDB and compare all rows and values."""

from __future__ import annotations

import os
import sys
import time
from multiprocessing.pool import ThreadPool

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "iufb":
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: "" if v is None or (isinstance(v, float) and np.isnan(v)) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return df.sort_values(list(df.columns), na_position="last", kind="mergesort").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} vs {len(sql_pdf)}"
    a, b = _plain(spark_pdf), _plain(sql_pdf)
    bad = []
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        else:
            same = a[c].astype(str) == b[c].astype(str)
        if not same.all():
            i = int(np.argmin(same.values))
            bad.append(f"{c}: {int((~same).sum())} differ, first {a[c][i]!r} vs {b[c][i]!r}")
    ka, kb = kinds(spark_pdf), kinds(sql_pdf)
    for c in ka:
        if ka[c] != kb[c] and len(spark_pdf) and {ka[c], kb[c]} != {"i", "f"}:
            bad.append(f"{c}: kind {ka[c]} vs {kb[c]}")
    return "; ".join(bad)


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    from tideline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    if names == ["sql"]:
        chosen = [n for n in queries if n in sql]

    def one(name: str) -> int:
        t0 = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"ROWS {name} {len(got)} rows {t1 - t0:.1f}s", flush=True)
                return 0
            note = differences(got, con.cursor().execute(sql[name]).df())
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            print(f"{'FAIL' if note else 'ok'} {name} {len(got)} rows {t1 - t0:.1f}s {note} {'ALLNULL ' + str(nulls) if nulls else ''}", flush=True)
            return int(bool(note))
        except Exception as err:
            print(f"ERROR {name} {type(err).__name__} {str(err)[:600]}", flush=True)
            return 1

    with ThreadPool(int(os.environ.get("COMPARE_THREADS", "1"))) as pool:
        failed = sum(pool.map(one, chosen, chunksize=1))
    print(f"{len(chosen)} queries, {failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
