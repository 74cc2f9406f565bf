"""Comparison of results with those of SQL."""

from __future__ import annotations


def frames_equal(a, b) -> None:
    """Same columns and rows, in any order; -0.0 is 0.0 and any null is a null."""
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols

    def canonical(f):
        out = []
        for row in f[cols].itertuples(index=False):
            out.append(tuple(None if v is None or v != v else (float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in (x.item() if hasattr(x, "item") else x for x in row)))
        return sorted(out, key=repr)

    assert canonical(a) == canonical(b)
