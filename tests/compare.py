"""Run registered queries and their SQL twins side by side and report the differences."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    mine_cols, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    their_cols, theirs = _rows(cols, cur.fetchall())
    if mine_cols != their_cols:
        return f"columns {mine_cols} != {their_cols}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        only_mine = sorted(set(mine) - set(theirs), key=repr)[:4]
        only_theirs = sorted(set(theirs) - set(mine), key=repr)[:4]
        return f"{len(bad)} rows differ; mine {only_mine} theirs {only_theirs}"
    return None
