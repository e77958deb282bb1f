"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short account of the difference."""
    df = run(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a == b:
        return None if a else "no rows on either side"
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return (
        f"rows {len(a)} vs {len(b)}; columns {sorted(columns)}\n"
        f"  only spark: {sorted(sa - sb)[:3]}\n  only sql:   {sorted(sb - sa)[:3]}"
    )
