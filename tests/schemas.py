"""List queries whose Spark column types differ from those of their SQL."""

from __future__ import annotations

import sys
from multiprocessing.pool import ThreadPool

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

import __spark_entry__ as entry  # noqa: E402
from compare import connection  # noqa: E402

from tideline.session import local_session  # noqa: E402

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def main(sf: str) -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connection(sf), entry.queries(), entry.oracle_sql()

    def one(name: str) -> None:
        mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in queries[name](spark, sf).schema}
        theirs = {r[0]: r[1] for r in con.cursor().execute("DESCRIBE " + sql[name]).fetchall()}
        bad = {c: (t, theirs.get(c)) for c, t in mine.items() if theirs.get(c) != t}
        if bad:
            print(name, bad, flush=True)

    with ThreadPool(5) as pool:
        pool.map(one, [n for n in queries if n in sql], chunksize=1)


if __name__ == "__main__":
    main(sys.argv[1])
