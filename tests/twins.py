"""Compare a query with its SQL twin, values and column families."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("D", str(v.normalize()))
    if isinstance(v, float):
        return ("F", repr(v)) if v == v else None
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def differences(df, sql: str, c) -> list[str]:
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[k]) for k in columns)) for r in df.collect())
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(k) for k in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    return [] if ours == theirs else [*sorted(set(ours) - set(theirs))[:2], *sorted(set(theirs) - set(ours))[:2], f"{len(ours)} and {len(theirs)} rows"]


__all__ = ["connect", "differences"]
