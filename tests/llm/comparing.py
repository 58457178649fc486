from __future__ import annotations


def assert_same_rows(frame, relation):
    """A Spark and a DuckDB result hold the same columns and rows, in any order."""
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    got = sorted([tuple(r) for r in frame.select(*names).collect()], key=str)
    assert got == sorted(relation.project(", ".join(names)).fetchall(), key=str)
