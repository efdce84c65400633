"""Fixed-size bitmaps of hashes: a cheap first look before an exact step, whatever the number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(h: Column, bits: int) -> Column:
    """The place of a 64-bit hash in a bitmap of 2 ** bits."""
    return h.bitwiseAND((1 << bits) - 1)


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the bitmap of column ``h``: 2 ** bits / 8 of them; a full one only saves nothing."""
    h = slots.select((F.col("h") + 1).alias("h"))
    rows = h.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = np.zeros(max((1 << bits) // 8, 4096), dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return out


def there(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
