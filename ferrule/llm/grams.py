"""Byte n-grams as longs, and what of a table of counts is frequent enough to be sent to every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands before a text's first byte and after its last; UTF-8 has no such byte.
_EDGE = 255


def codes(part: pa.Array, lead: bytes, ends: bool, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each position, its gram) of texts, with the ``order`` bytes before it in the higher places; ``lead`` stands before them, and each ends here or not at all."""
    n, front = len(part), 7 - order
    ends_at = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    size, place = np.diff(ends_at), np.arange(n)
    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends_at[0] : ends_at[-1]]
    out = np.full(front + len(data) + n * (order + ends), _EDGE, np.uint8)
    out[np.arange(len(data)) + np.repeat(front + order * (place + 1) + place * ends, size)] = data
    if lead:
        out[front : front + order] = np.frombuffer(lead[-order:].rjust(order, bytes([_EDGE])), np.uint8)
    at = np.arange(len(data) + n * ends) + np.repeat(order * (place + 1) - order, size + ends)  # of the 8 bytes that end with the symbol
    held = np.ndarray((max(0, len(out) - 7),), ">u8", out, 0, (1,)).astype(np.int64)
    return np.repeat(place, size + ends), held[at] & ((1 << 8 * (order + 1)) - 1)


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with how often they stand."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[first], b[first], np.diff(np.append(first, len(a)))


def least_count(df: DataFrame, most: int) -> int:
    """The least count from which on the rows of ``df`` (with n_all) number at most ``most``."""
    step = F.floor(F.log2("n_all") * 8)
    sizes = df.where("n_all > 0").groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n_all").alias("least")).orderBy(F.col("step").desc()).collect()  # at most 8 rows a doubling
    rows, least = 0, 1 << 62
    for r in sizes:
        rows += r["rows"]
        if rows > most:
            break
        least = r["least"]
    return least
