"""Compare a registered query with its SQL counterpart run by DuckDB."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), sorted(names)


def _kind(t: str) -> str:
    t = t.lower()
    for kind, words in {
        "int64": ("bigint", "hugeint"),
        "int32": ("int",),
        "float": ("double", "decimal", "float"),
        "text": ("string", "varchar"),
        "time": ("timestamp",),
        "bool": ("bool",),
    }.items():
        if any(t.startswith(w) for w in words):
            return kind
    return t


def compare(df, con, sql) -> str | None:
    """None when they agree, else what differs."""
    got, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    desc = [(c[0], str(c[1])) for c in cur.description]
    want, wanted = _rows([c[0] for c in desc], cur.fetchall())
    if names != wanted:
        return f"columns {names} != {wanted}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    theirs = {n: _kind(t) for n, t in desc}
    odd = {n: (ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]}
    return f"types {odd}" if odd else None
