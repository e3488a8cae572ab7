"""Run a query in Spark and its SQL in DuckDB and compare schema and rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return repr(x)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df, sql, con):
    """A list of complaints, empty when both agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = _rows(cursor.fetchall(), names)
    actual = _rows([tuple(r) for r in df.collect()], df.columns)
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if _TYPES.get(kind, kind) != types[name]:
            out.append(f"{name}: {kind} != {types[name]}")
    if len(actual) != len(expected):
        out.append(f"{len(actual)} rows != {len(expected)}")
    if actual != expected:
        wrong = [p for p in zip(actual, expected) if p[0] != p[1]][:3]
        out.append(f"rows differ, e.g. {wrong}")
    if not expected:
        out.append("no rows")
    return out
