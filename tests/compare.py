"""Compares the rows of a query with those of its SQL."""

import math


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if type(value).__name__ in ("float", "Decimal", "int"):
        return "nan" if value != value else round(float(value), 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def same_rows(got, want):
    key = lambda row: tuple(str(x) for x in row)
    got, want = sorted((tuple(map(plain, r)) for r in got), key=key), sorted((tuple(map(plain, r)) for r in want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            close = isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)
            assert x == y or close, (a, b)


def check_query(query, sql, spark, duck, data):
    frame = query(spark, data)
    columns = sorted(frame.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    same_rows([[r[c] for c in columns] for r in frame.collect()], [[r[i] for i in order] for r in result.fetchall()])
