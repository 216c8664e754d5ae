"""CRC-32C (Castagnoli) of binary columns: no built-in exists, so a table-driven Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POLY = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t.astype(np.uint32)


TABLE = _table()


def crc32c_many(values: list[bytes | None]) -> list[int | None]:
    """Checksums of many values at once: one vector step for each byte position."""
    idx = [i for i, v in enumerate(values) if v is not None]
    out: list[int | None] = [None] * len(values)
    if not idx:
        return out
    idx.sort(key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in idx])
    width = int(sizes[0])
    data = np.zeros((len(idx), max(1, width)), np.uint8)
    for r, i in enumerate(idx):
        data[r, : sizes[r]] = np.frombuffer(values[i], np.uint8)
    crc = np.full(len(idx), 0xFFFFFFFF, np.uint32)
    for k in range(width):
        n = int(np.searchsorted(-sizes, -k, "left"))  # rows longer than k come first
        crc[:n] = TABLE[(crc[:n] ^ data[:n, k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    for r, i in enumerate(idx):
        out[i] = int(crc[r] ^ np.uint32(0xFFFFFFFF))
    return out


def crc32c(value: bytes) -> int:
    return crc32c_many([value])[0]


@F.pandas_udf(T.LongType())
def crc32c_col(values: pd.Series) -> pd.Series:
    return pd.Series(crc32c_many([None if v is None else bytes(v) for v in values]), dtype="Int64")
