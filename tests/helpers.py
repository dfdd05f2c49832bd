"""Shared by the tests."""

SMALL = "/root/testdata/sf0.001"


def same_rows(frame, con, sql):
    """Rows of a query and of its SQL, columns by name, in any order; returns their number."""
    import decimal

    cols = sorted(frame.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    plain = lambda row: repr([int(x) if isinstance(x, decimal.Decimal) else x for x in row])
    got = sorted(plain(tuple(r)) for r in frame.select(*cols).collect())
    want = sorted(plain(tuple(r[i] for i in at)) for r in result.fetchall())
    assert got == want
    return len(got)
