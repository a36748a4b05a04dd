"""Exact quantiles without a sort and without one task that sees all values: nested histograms of ordered bit prefixes.

A double's 64 bits, in an order that follows the values, are read as four digits of 16 bits.  A round counts one digit of those
values whose earlier digits are a wanted rank's; tasks count by themselves and send the digits that occur.  After
four rounds every wanted rank has its value, whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.storage import discard, materialize

DIGITS, BITS = 4, 16


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the values; -0.0 equals 0.0, NaN stands last."""
    raw = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63) == 1, ~raw, raw | np.uint64(1 << 63))


def value_of(bits: int) -> float:
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def at_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at places of the sorted column (from 0) of a frame with one column of doubles that are not null."""
    found: dict[int, int] = dict.fromkeys(ranks, 0)  # rank to the digits so far
    below = dict.fromkeys(ranks, 0)  # values that are less than these digits' values
    for digit in range(DIGITS):
        shift = np.uint64(64 - BITS * (digit + 1))
        prefixes = np.array(sorted(set(found.values())), np.uint64)

        def count(batches: Iterator[pa.RecordBatch], prefixes=prefixes, shift=shift, digit=digit) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(prefixes), 1 << BITS), np.int64)
            for batch in batches:
                bits = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
                head = bits >> (shift + np.uint64(BITS)) if digit else np.zeros(len(bits), np.uint64)
                at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                mine = prefixes[at] == head
                key = at[mine] * (1 << BITS) + ((bits[mine] >> shift) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                held += np.bincount(key, minlength=held.size).reshape(held.shape)
            at, d = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d, pa.int32()), pa.array(held[at, d])], ["at", "digit", "n"])

        counted = values.mapInArrow(count, "at int, digit int, n long").groupBy("at", "digit").agg(F.sum("n").alias("n")).toPandas()
        for rank, prefix in list(found.items()):
            mine = counted[counted["at"] == int(np.searchsorted(prefixes, np.uint64(prefix)))].sort_values("digit")
            upto = below[rank] + mine["n"].cumsum().to_numpy()
            i = int(np.searchsorted(upto, rank, side="right"))
            found[rank] = prefix << BITS | int(mine["digit"].iloc[i])
            below[rank] = int(upto[i] - mine["n"].iloc[i])
    return {r: value_of(b) for r, b in found.items()}


def quantiles(df: DataFrame, column: Column | str, shares: list[float]) -> list[float | None]:
    """Linear quantiles of a column, as ``percentile`` gives them; nulls are left out, and without values all are None."""
    values = materialize(df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v IS NOT NULL"), "quantiles")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    held = at_ranks(values, sorted({r for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}))
    discard(values)
    out = []
    for p in places:
        low, high = int(np.floor(p)), int(np.ceil(p))
        out.append(held[low] if low == high or held[low] == held[high] else (high - p) * held[low] + (p - low) * held[high])
    return out
