"""What both vector operators share: valid vectors, rotation, pivots from a bounded sample, packed block rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which rotations' scales and pivots are fitted, chosen by a hash of their ids.
FIT_ROWS = 16_000


def kind(df: DataFrame, vec_col: str) -> str:
    """The type in which vectors are held and sent: that of the column, if it is an array of doubles or floats."""
    return "array<double>" if df.schema[vec_col].dataType.simpleString() == "array<double>" else "array<float>"


def number(x: DataFrame, vec_col: str = "v"):
    """The numpy type of a vector column's components."""
    return np.float64 if kind(x, vec_col) == "array<double>" else np.float32


def valid(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, v) of usable vectors, their dimension and number; v is array<double> where the column is, else array<float>.

    Null, empty and zero vectors, vectors with null or non-finite components, and null ids are left out; where lengths
    differ, the most frequent (of equals the greatest) is the dimension and the others are left out.
    """
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind(df, vec_col)).alias("v"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda e: e != 0))
    dims = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return x.where("false"), 0, 0
    return x.where(F.size("v") == dims["d"]), dims["d"], dims["n"]


def sample(x: DataFrame, rows: int = FIT_ROWS, salt: str = "fit") -> tuple[np.ndarray, np.ndarray]:
    """(ids, float64 matrix) of at most `rows` rows, those whose ids hash lowest."""
    got = x.orderBy(F.xxhash64("id", F.lit(salt)), "id", "v").limit(rows).toArrow()
    ids = got.column("id").to_numpy()
    return ids, matrix(got.column("v"), len(ids))


def matrix(col, n: int) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if hasattr(col, "combine_chunks"):
        col = col.combine_chunks()
    if not n:
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for every call."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def pivots(x: np.ndarray, k: int, steps: int = 8, seed: int = 11) -> np.ndarray:
    """k-means centres of a sample (fewer where it has fewer distinct rows)."""
    x = np.ascontiguousarray(x)
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(steps):
        a = sq_distances(x, c).argmin(1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0][:, None]
    return np.unique(c, axis=0)


class Buffers:
    """Gathers rows by key and gives them out in full blocks."""

    def __init__(self, rows: int):
        self.rows, self.held = rows, {}

    def add(self, key, *cols: np.ndarray):
        """Yields (key, columns) for every block that is full."""
        own = self.held.setdefault(key, [])
        own.append(cols)
        if sum(len(c[0]) for c in own) >= self.rows:
            full = [np.concatenate(c) for c in zip(*own)]
            n = len(full[0]) // self.rows * self.rows
            for at in range(0, n, self.rows):
                yield key, [c[at : at + self.rows] for c in full]
            self.held[key] = [tuple(c[n:] for c in full)] if n < len(full[0]) else []

    def rest(self):
        for key, own in self.held.items():
            if own:
                yield key, [np.concatenate(c) for c in zip(*own)]
        self.held = {}
