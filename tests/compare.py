"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool",
    "string": "str", "date": "date", "timestamp_ntz": "ts", "timestamp": "ts",
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float",
    "BOOLEAN": "bool", "VARCHAR": "str", "DATE": "date", "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "tstz",
}


def compare(df, con, sql: str | None) -> str:
    """Empty of ``DIFF`` when both results hold the same columns, kinds of type and rows."""
    rows = df.collect()
    if sql is None:
        return f"rows-only {len(rows)}"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} != {sorted(names)}"
    types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    off = {n: (types[n], kinds[n]) for n in names if types[n] != kinds[n] and types[n] in KINDS.values()}
    order = sorted(names)
    got = sorted(repr(tuple(_plain(r[n]) for n in order)) for r in rows)
    at = [names.index(n) for n in order]
    exp = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in want)
    if got != exp:
        mine, theirs = set(got), set(exp)
        extra = [g for g in got if g not in theirs][:3]
        lost = [e for e in exp if e not in mine][:3]
        return f"DIFF rows {len(got)} vs {len(exp)} {order}\n   spark {extra}\n   sql   {lost}"
    if off:
        return f"DIFF types {off}"
    return f"equal {len(got)}"
