"""Equality of a query's rows with those of its SQL, whatever their order."""

from __future__ import annotations

import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    theirs = Counter(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
    ours = Counter(repr(tuple(plain(r.asDict(True)[n]) for n in names)) for r in df.collect())
    assert ours == theirs
