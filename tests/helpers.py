"""What several test modules use."""


def _rank(value):
    if value is None:
        return (0, 0, "")
    return (1, value, "") if isinstance(value, (int, float)) else (2, 0, str(value))


def rows(df, *columns):
    """All rows as a sorted list of tuples; NaN as text, so that equal rows compare equal."""
    picked = df.select(*columns) if columns else df
    plain = lambda v: "NaN" if isinstance(v, float) and v != v else v
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=lambda r: [_rank(v) for v in r])
