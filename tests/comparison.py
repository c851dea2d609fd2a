"""Rows of a query and of its SQL in one form."""

from __future__ import annotations

import pandas as pd


def plain(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v).isoformat().removesuffix("T00:00:00")
    if isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    f = float(v)
    return str(int(f)) if f == int(f) else f"{f:.6g}"


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))
