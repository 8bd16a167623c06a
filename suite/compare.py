"""Run registered queries against DuckDB: ``python -m suite.compare <sf_dir> [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(value)) for value in row)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when columns, types and values agree exactly; else what differs."""
    relation = connection.sql(sql)
    theirs_types = {c: _TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    mine_types = dict(spark_df.dtypes)
    if mine_types != theirs_types:
        return f"types: {sorted(mine_types.items() ^ theirs_types.items())}"
    columns = sorted(mine_types)
    mine = sorted((tuple(row[c] for c in columns) for row in spark_df.collect()), key=_key)
    theirs = sorted(connection.sql(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall(), key=_key)
    if len(mine) != len(theirs):
        return f"rows: {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b and not any(isinstance(x, float) and math.isnan(x) for x in a):
            return f"values: {dict(zip(columns, a))} != {dict(zip(columns, b))}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import suite.all  # noqa: F401
    from suite.registry import ORACLES, QUERIES
    from trailmark.session import local_session

    spark = local_session(name="compare")
    connection = connect(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, connection, ORACLES[name])
                label = "ok" if problem is None else f"DIFF {problem}"
            else:
                problem, label = None, f"rows {df.count()}"
        except Exception as error:  # report and go on
            problem, label = error, f"ERROR {str(error)[:600]}"
        failures += problem is not None
        print(f"{time.time() - started:6.2f}s {name}: {label[:900]}", flush=True)
    print(f"{failures} of {len(names or QUERIES)} differ")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    sys.exit(main(sys.argv[1], sys.argv[2:]))
