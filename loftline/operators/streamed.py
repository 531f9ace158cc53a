"""Sorted rows that are read batch by batch in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Which rows differ from the row before in one of the columns; nulls are alike."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for name in names:
        a, b = table[name].slice(0, max(0, len(table) - 1)), table[name].slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] |= ~same.to_numpy().astype(bool)
    return out
