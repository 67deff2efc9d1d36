"""Rows of both engines in one form."""

import math


def plain(v):
    """A value as both engines give it: no nan, no numpy, floats to nine places."""
    if v is None or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(frame):
    """Rows of a pandas frame, columns by name, in any order."""
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def same(df, sql, duck):
    got, want = df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
