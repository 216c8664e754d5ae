"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance D = 2 - 2 c. After a random rotation the columns are split
into low-dimensional blocks; of the squared distance of a linked pair at least one block holds no more than its
proportional share of D (its share of the columns).

Vectors are stored once, in row blocks of bounded size whose rows lie in the cell of one pivot (k-means centres of a
bounded sample) where there are enough of them. Every two row blocks meet once, read from where they are stored: no
vector is copied to further cells, so that what is on disk grows as the input. Of two row blocks those rows are
compared that may reach the other's ball (centre and radius) within the budget of some column block. Pairs whose inner
product can be c, told from leading columns and the length of the rest, in single precision with slack, are verified
in double precision on the original vectors.

Tasks give out sums of links and local star edges, at most one row for each vector of a pair of blocks, never pairs.
Equal vectors are one node with a weight.

Edge cases: unusable vectors (see vectors.valid) link with nothing and keep their own component (null ids: a null
component, kept); repeated rows count as further vectors; rows that share an id are in one component; other columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as vx
from .base import components, lean, materialize, small_batches, stored, swept_shuffles, wide_rows

BLOCK_COLUMNS = 16
#: Rows of a row block: about the 64th part of all, between these, and no more than BLOCK_BYTES.
ROWS, BLOCK_BYTES = (256, 4096), 2 << 20
#: Vectors that a task gathers into row blocks; most cells.
TASK_ROWS, CELLS = 1 << 18, 256
#: Rows of a block that are compared at once, and parsed blocks that a task keeps.
TILE, KEPT = 512, 16
#: Sample rows from which the number of leading columns is chosen; the time of a verified pair in those of a column.
TRIED, VERIFY = 1024, 5000


class Plan:
    """Rotation, column blocks and budgets; pivots, and the leading columns by which pairs are judged first."""

    def __init__(self, x: np.ndarray, cosine: float, columns: int = BLOCK_COLUMNS, cells: int = 1):
        d = x.shape[1]
        self.cosine, self.turn = cosine, vx.rotation(d)
        edges = [*range(0, d, columns), d]
        self.cols = list(zip(edges[:-1], edges[1:]))
        total = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
        self.budget = [total * (b - a) / d for a, b in self.cols]
        #: What single precision may lose of an inner product of unit vectors, with plenty to spare.
        self.slack = 1e-4 + 1e-6 * d
        y = self.rotated(x)
        self.pivots = vx.pivots(y, cells)
        axes = np.linalg.eigh(y.T @ y)[1][:, ::-1]
        z = y[:TRIED] @ axes
        cost = {}
        for m in range(min(4, d), d + 1, max(1, d // 32)):
            f = _leading(z, m)
            cost[m] = m + VERIFY * float((f @ f.T >= cosine - self.slack).mean())
        self.axes = axes[:, : min(cost, key=cost.get)]

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Rows at length 1; scaled first, so that neither tiny nor huge components are lost."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return self.unit(x) @ self.turn

    def shares(self, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Distances of rotated rows to a point, in every column block."""
        return np.sqrt(np.add.reduceat((y - centre) ** 2, [a for a, _ in self.cols], axis=1))


def _leading(z: np.ndarray, m: int) -> np.ndarray:
    """The first m columns of unit rows and the length of the rest: inner products of these are no less than the rows'."""
    return np.column_stack([z[:, :m], np.sqrt(np.maximum(0, 1 - (z[:, :m] ** 2).sum(1)))]).astype(np.float32)


class Rows:
    """A row block as tasks compare it."""

    def __init__(self, plan: Plan, ids: np.ndarray, weights: np.ndarray, v: np.ndarray):
        self.plan, self.ids, self.weights, self.v = plan, ids, weights, v
        y = plan.rotated(v.astype(np.float64))
        self.leading = _leading(y @ plan.axes, plan.axes.shape[1])
        self.centre = y.mean(0)
        self.radius = plan.shares(y, self.centre).max(0)
        self.y = y.astype(np.float32)

    @functools.cached_property
    def unit(self) -> np.ndarray:
        return self.plan.unit(self.v.astype(np.float64))

    def near(self, other: Rows) -> np.ndarray:
        """Numbers of the rows that may be within a column block's budget of a row of the other block."""
        reach = other.radius + np.sqrt(self.plan.budget) + self.plan.slack
        return np.flatnonzero((self.plan.shares(self.y, other.centre.astype(np.float32)) <= reach).any(1))


def pairs(one: Rows, two: Rows, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (rows of block one, rows of block two), in parts of bounded size; of a block with itself each pair once."""
    cosine, low = one.plan.cosine, np.float32(one.plan.cosine - one.plan.slack)
    a, b = (np.arange(len(one.ids)),) * 2 if same else (one.near(two), two.near(one))
    if not len(a) or not len(b):
        return
    guests = np.ascontiguousarray(two.leading[b].T)
    for s in range(0, len(a), TILE):
        rows = a[s : s + TILE]
        at = np.flatnonzero(one.leading[rows] @ guests >= low)
        if len(at) > len(rows) * len(b) // 64:  # many: one product in double precision is faster
            at = np.flatnonzero((one.unit[rows] @ two.unit[b].T).ravel() >= cosine) if len(at) else at
            i, j = rows[at // len(b)], b[at % len(b)]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        i, j = rows[at // len(b)], b[at % len(b)]
        if same:
            i, j = i[i < j], j[i < j]
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 32768):
            ok[k : k + 32768] = np.einsum("ij,ij->i", one.unit[i[k : k + 32768]], two.unit[j[k : k + 32768]]) >= cosine
        if ok.any():
            yield i[ok], j[ok]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least members of components, after the pairs a, b are joined too."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == root[root]).all():
            root = root[root]


def compare(one: Rows, two: Rows, same: bool):
    """(ids, an id of their component, links) of the rows of two blocks that are linked between them."""
    off = 0 if same else len(one.ids)
    size = off + len(two.ids)
    total, root = np.zeros(size), np.arange(size)
    for i, j in pairs(one, two, same):
        j = j + off
        total += np.bincount(i, two.weights[j - off], size) + np.bincount(j, one.weights[i], size)
        root = unite(root, i, j)
    at = np.flatnonzero(total)
    ids = one.ids if same else np.concatenate([one.ids, two.ids])
    return ids[at], ids[root[at]], total[at].astype(np.int64)


@stored("found")
def links(x: DataFrame, d: int, n: int, cosine: float) -> DataFrame:
    """(id, to, links) partial rows: summed weights of linked nodes and an edge, for nodes (key, id, v, weight).

    What is called id here and in the result is the key, which no two nodes share.
    """
    spark = x.sparkSession
    real = vx.number(x)
    rows = max(1, min(max(ROWS[0], min(ROWS[1], n // 64)), BLOCK_BYTES // (d * np.dtype(real).itemsize)))
    tasks = max(8, n // TASK_ROWS)
    cells = max(1, min(CELLS, n // tasks // (4 * rows)))
    plan = spark.sparkContext.broadcast(Plan(vx.sample(x.select("id", "v"))[1], cosine, cells=cells))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pl, held = plan.value, vx.Buffers(rows)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                ids, v, w = part.column(0).to_numpy(), vx.matrix(part.column(1), part.num_rows), part.column(2).to_numpy()
                home, raw = vx.sq_distances(pl.rotated(v), pl.pivots).argmin(1), v.astype(real)
                for c in np.unique(home):
                    m = home == c
                    for _, block in held.add(int(c), ids[m], w[m], raw[m]):
                        yield row(*block)
        left = [cols for _, cols in sorted(held.rest())]  # too few of a cell: neighbours by number share blocks
        if left:
            every = [np.concatenate(c) for c in zip(*left)]
            for at in range(0, len(every[0]), rows):
                yield row(*(c[at : at + rows] for c in every))

    def row(ids, w, v):
        # a block's name: its least key, which no other block has
        return pa.RecordBatch.from_arrays(
            [pa.array([int(ids.min())], pa.int64())] + [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (ids, w, v)],
            ["name", "ids", "w", "v"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pl, last, kept = plan.value, (None, None), {}

        def block(name, cols, r):
            ids, w, v = (c[r].as_py() for c in cols)
            return Rows(pl, np.frombuffer(ids, np.int64), np.frombuffer(w, np.int64), np.frombuffer(v, real).reshape(-1, d))

        for b in batches:
            cols = [b.column(k) for k in range(8)]
            for r in range(b.num_rows):
                name, other = cols[0][r].as_py(), cols[4][r].as_py()
                if last[0] != name:
                    last = (name, block(name, cols[1:4], r))
                if other != name and other not in kept:
                    if len(kept) >= KEPT:
                        kept.pop(next(iter(kept)))
                    kept[other] = block(other, cols[5:8], r)
                ids, root, total = compare(last[1], last[1] if other == name else kept[other], other == name)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(total)], ["id", "to", "links"])

    blocks = x.select(F.col("key").alias("id"), "v", "weight").coalesce(tasks).mapInArrow(lean(gather), "name long, ids binary, w binary, v binary")
    blocks = materialize(blocks, "blocks", wide=True)
    home = blocks.select(*(F.col(c).alias(f"home_{c}") for c in blocks.columns))
    # of (a, b) and (b, a) one meets, by chance, so that all tasks have as much to do
    even = (F.xxhash64("home_name").bitwiseXOR(F.xxhash64("name")).bitwiseAND(F.lit(1))) == 0
    meet = (F.col("home_name") == F.col("name")) | ((F.col("home_name") != F.col("name")) & ((F.col("home_name") < F.col("name")) == even))
    # a task for any two files: blocks are read there, not shuffled
    return home.hint("shuffle_replicate_nl").join(blocks, meet).mapInArrow(lean(match), "id long, to long, links long")


@stored("classes")
def classes(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    small_batches(df.sparkSession)
    with swept_shuffles(df.sparkSession):
        return _classes(df, cosine, id_col, vec_col)


def _classes(df: DataFrame, cosine: float, id_col: str, vec_col: str) -> DataFrame:
    x, d, n = vx.valid(df, id_col, vec_col)
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(vx.kind(df, vec_col)).alias("v"))
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # equal vectors are one node; its id is the least, and its key too unless another node has the same
    nodes = materialize(x.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id()), "nodes", wide=True)
    unique = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    nodes = nodes.withColumn("key", F.col("id")) if unique else nodes
    # rows and their nodes, stored so that a join with a vector that very many rows have can be split; vectors move no more
    rows = materialize(every.join(nodes.select("v", "key"), "v", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")), "rows")
    with wide_rows(df.sparkSession):
        found = links(nodes, d, n, cosine)
    part = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")).unionByName(_twice(rows)))
    if not unique:  # components are named by keys
        least = part.join(nodes.select(F.col("key").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("id"))
        part = part.join(least, "component").select("node", F.col("id").alias("component"))
    sums = found.groupBy(F.col("id").alias("key")).agg(F.sum("links").alias("links"))
    known = nodes.select("key", "id", "weight").join(sums, "key", "left").join(part.withColumnRenamed("node", "key"), "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = materialize(known, "known")
    out = rows.join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _twice(rows: DataFrame) -> DataFrame:
    """Edges that unite rows of one id with different vectors."""
    own = rows.where("vec_id is not null and key is not null")
    least = own.groupBy("vec_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("vec_id", "least")
    return own.join(least, "vec_id").select(F.col("key").alias("u"), F.col("least").alias("v")).distinct()
