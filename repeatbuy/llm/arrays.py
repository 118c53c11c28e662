"""Whole-number vectors in DataFrames, and numpy arrays packed into binary columns."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from repeatbuy.llm.common import by_value

by_value(__name__)


def scaled(column: str, scale: int) -> Column:
    """floor(scale x) of every component as doubles, which hold it exactly; null for a vector that is
    null or holds a null or non-finite component, or one whose scaled value no double holds."""
    x = F.transform(column, lambda v: v.cast("double") * scale)
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    # From 2**52 on a double is whole already, and floor() would cut it to a long.
    floor = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    return F.when(fine, floor)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix, short ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if len(values):
        out[np.arange(width) < sizes[:, None]] = values
    return out


def small(values: np.ndarray) -> np.ndarray:
    """Whole numbers as int32 where they fit, which halves their room."""
    return values.astype(np.int32) if not values.size or np.abs(values).max() < 1 << 31 else values


def whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers, for products that no machine word holds."""
    flat = [int(x) for x in values.ravel()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def pack(**arrays: np.ndarray) -> bytes:
    body = io.BytesIO()
    np.savez(body, **arrays)
    return body.getvalue()


def unpack(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}
