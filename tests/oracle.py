"""Side-by-side run of the registered queries and their SQL."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SAME_TYPE = {"int": "integer", "string": "varchar", "timestamp_ntz": "timestamp"}


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return str(value)

    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(df, db, sql):
    """None when both agree, else a short description."""
    columns, rows = canonical(df.columns, df.collect())
    relation = db.execute(sql)
    want_columns, want = canonical([d[0] for d in relation.description], relation.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    types = {name: SAME_TYPE.get(kind, kind) for name, kind in df.dtypes}
    want_types = {d[0]: str(d[1]).lower() for d in relation.description}
    if types != want_types:
        return f"types {types} != {want_types}"
    if rows != want:
        extra, missing = sorted(set(rows) - set(want))[:2], sorted(set(want) - set(rows))[:2]
        return f"{len(rows)} rows != {len(want)}; extra {extra}; missing {missing}"[:1500]
    return None if rows else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from linkloom.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in sql or names and name not in names:
            continue
        start = time.time()
        try:
            result = difference(query(spark, folder), db, sql[name])
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name:20s} {time.time() - start:6.2f}s  {'ok' if result is None else result}", flush=True)
