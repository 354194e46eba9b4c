"""Compare every registered query with its SQL counterpart: ``python tests/compare.py SF_DIR [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


_KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def _cell(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def _sorted(rows):
    return sorted((tuple(_cell(v) for v in row) for row in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, con, sql):
    """None when names, types and values agree, else a description."""
    kinds = {name: _KINDS.get(kind, kind.upper().replace("DECIMAL", "DECIMAL")) for name, kind in df.dtypes}
    relation = con.sql(sql)
    found = {name: str(kind).replace(" ", "") for name, kind in zip(relation.columns, relation.types)}
    if found != kinds:
        extra = {k: (kinds.get(k), found.get(k)) for k in {*kinds, *found} if kinds.get(k) != found.get(k)}
        return f"schema (spark, duckdb): {extra}"
    names = sorted(kinds)
    left = _sorted(df.select(*names).collect())
    right = _sorted(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    if len(left) != len(right):
        return f"rows: {len(left)} and {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, columns {names}, e.g. {wrong[0]}" if wrong else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, oracle = local_session("8", 8), connect(sf_dir), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            verdict = difference(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None and not verdict.startswith("no SQL")
        print(f"{name}: {verdict or 'ok'} ({time.time() - start:.1f} s)", flush=True)
    print(f"{bad} bad; without query: {sorted(set(oracle) - set(queries()))}")


if __name__ == "__main__":
    main()
