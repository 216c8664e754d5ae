"""Approximate nearest neighbours by adaptive dimension scans of rotated column blocks in an inverted file.

Largest inner product becomes least distance by one more dimension that gives all vectors one length. Vectors are then
rotated at random, so that any leading columns are a fair sample of a distance. Lists are the cells of k-means centres
fitted on a bounded sample, more of them for more rows; each is stored as blocks of rows, scanned in blocks of columns.
After each column block a candidate is abandoned if its partial distance, scaled up, exceeds the query's threshold by
more than the hypothesis test allows. A query's threshold starts as its `top`-th best inner product within SEED_ROWS rows
of the sample, which are true candidates; it visits its NEAR nearest lists with that, and the others with the threshold
that these gave. Survivors are scored exactly, in double precision, on the original vectors.

How many lists are probed is found on the sample: the least number that reaches `recall` there. Every row is indexed.
A list of many blocks is dealt to several tasks, and its queries go to all of them.

Edge cases: unusable vectors (see vectors.valid) are neither queries nor candidates; rows that share an id act as one
vector with several positions and are never their own neighbours; ties go to the smaller id; a query with fewer
candidates than `top` gets all of them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vx
from .base import lean, materialize, small_batches, stored, wide_rows

COLUMNS = 16
EPSILON = 2.1
LIST_ROWS, QUERY_ROWS = 2048, 2048
#: Rows of the sample whose exact scores give thresholds.
SEED_ROWS = 1024
#: Lists that a query visits first: what they hold gives the threshold for the others.
NEAR = 2
#: Blocks of a list that meet in one task.
LIST_BLOCKS = 32


class Index:
    """Rotation, centres and probes; a few MB whatever the input."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, greatest: float, lists: int, top: int, recall: float, probes: int | None = None):
        d = x.shape[1]
        self.greatest, self.turn = greatest, vx.rotation(d + 1)
        self.top = top
        y = self.lift(x)
        self.centres = vx.pivots(y, lists)
        self.probes = min(len(self.centres), probes or self.calibrate(x, y, recall))
        uniq, first = np.unique(ids[:SEED_ROWS], return_index=True)
        self.ids, self.x = uniq, x[first]

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.greatest**2 - (x * x).sum(1)))
        return np.concatenate([x, more[:, None]], axis=1) @ self.turn

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """Lists by distance of their centres, nearest first."""
        return np.argsort(vx.sq_distances(self.lift(q, True), self.centres), axis=1, kind="stable")

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, queries: int = 256) -> int:
        q = x[:queries]
        if len(x) <= self.top + 1:
            return len(self.centres)
        own = vx.sq_distances(y, self.centres).argmin(1)
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argpartition(-score, self.top, axis=1)[:, : self.top]
        order = self.ranked(q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def seeds(self, ids: np.ndarray, q: np.ndarray):
        """For each query the ids and exact scores of its `top` best seed rows; -inf where there are fewer."""
        s = q @ self.x.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] > self.top:
            best = np.argpartition(-s, self.top - 1, axis=1)[:, : self.top]
        else:
            best = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        return self.ids[best], np.take_along_axis(s, best, axis=1)

    def floor(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each query an inner product that `top` candidates reach, which seeds() names."""
        _, s = self.seeds(ids, q)
        return s.min(1) if s.shape[1] == self.top else np.full(len(q), -np.inf)


def scan(index: Index, qid, q, floor, cid, c, columns: int = COLUMNS, epsilon: float = EPSILON):
    """(query row, candidate row, score) of the `top` best ids of a block for every query of a block, thresholds applied.

    Of rows that share an id only the best counts, so that repeats leave room for others.
    """
    d = index.turn.shape[0]
    a, b = index.lift(q, True), index.lift(c)
    near = np.maximum(0, (q * q).sum(1) + index.greatest**2 - 2 * floor)  # squared distance that still counts
    near[~np.isfinite(floor)] = np.inf
    dense = np.zeros((len(q), len(c)))
    alive = qid[:, None] != cid[None, :]
    pairs = None
    for at in range(0, d, columns):
        end = min(d, at + columns)
        x, y = a[:, at:end], b[:, at:end]
        bound = near * (1 + (epsilon / np.sqrt(end) if end < d else 1e-9)) ** 2 * end / d + 1e-12 * index.greatest**2
        if end < d and not np.isfinite(epsilon):  # nothing is abandoned before its whole distance is known
            bound = np.full(len(q), np.inf)
        if pairs is None:
            dense += (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            alive &= dense <= bound[:, None]
            if np.count_nonzero(alive) * 4 < alive.size:
                pairs = np.nonzero(alive)
                part = dense[pairs]
        else:
            part = part + ((x[pairs[0]] - y[pairs[1]]) ** 2).sum(1)
            keep = part <= bound[pairs[0]]
            pairs, part = (pairs[0][keep], pairs[1][keep]), part[keep]
    i, j = np.nonzero(alive) if pairs is None else pairs
    score = np.concatenate([np.einsum("ij,ij->i", q[i[k : k + 65536]], c[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    o = np.lexsort((cid[j], -score, i))
    i, j, score = i[o], j[o], score[o]
    if len(np.unique(cid)) < len(cid):
        by = np.lexsort((np.arange(len(i)), cid[j], i))  # best first within a query and id
        new = np.ones(len(by), bool)
        new[1:] = (i[by][1:] != i[by][:-1]) | (cid[j[by]][1:] != cid[j[by]][:-1])
        o = np.sort(by[new])
        i, j, score = i[o], j[o], score[o]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < index.top
    return i[keep], j[keep], score[keep]


@stored("nearest")
def search(base: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, lists: int | None = None, recall: float = 0.96, fit_rows: int = vx.FIT_ROWS, seeded: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of base that is_query selects, its `top` nearest other rows.

    Everything is fitted on at most fit_rows rows. Lists grow as the square root of the rows, to one for 16 rows of the
    sample. The seed rows that gave thresholds belong to what was found; for measuring what the lists find alone,
    seeded=False leaves them out of the result.
    """
    spark = base.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    x, d, n = vx.valid(base, id_col, vec_col)
    if not n:
        return spark.createDataFrame([], schema)
    real = vx.number(x)
    queries = x.where(is_query(F.col("id")))
    length = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    greatest = float(np.sqrt(x.agg(F.max(length)).first()[0])) * (1 + 1e-9)
    n_queries = queries.count()
    lists = lists or int(min(max(1, fit_rows // 16), max(16, np.sqrt(n) / 2)))
    index = spark.sparkContext.broadcast(Index(*vx.sample(x, fit_rows), greatest, lists, top, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, held = index.value, vx.Buffers(LIST_ROWS)
        for b in batches:
            ids, v = b.column(0).to_numpy(), vx.matrix(b.column(1), b.num_rows)
            own = vx.sq_distances(ix.lift(v), ix.centres).argmin(1)
            for k in np.unique(own).tolist():
                for block in held.add(k, ids[own == k], v[own == k].astype(real)):
                    yield row(*block)
        for block in held.rest():
            yield row(*block)

    def row(key, cols):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32())] + [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols], ["list", *["ids", "v", "floor"][: len(cols)]])

    def probe(first: int, last: int):
        """Blocks of queries for the lists that are theirs from the first to before the last, nearest first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, held = index.value, vx.Buffers(QUERY_ROWS)
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    part = b.slice(s, 1024)
                    ids, v = part.column(0).to_numpy(), vx.matrix(part.column(1), part.num_rows)
                    floor = part.column(2).to_numpy()
                    if not first:
                        floor = np.maximum(floor, ix.floor(ids, v))
                    to = ix.ranked(v)[:, first:last]
                    for k in np.unique(to).tolist():
                        m = (to == k).any(1)
                        for block in held.add(k, ids[m], v[m].astype(real), floor[m]):
                            yield row(*block)
            for block in held.rest():
                yield row(*block)

        return run

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids = part.column(0).to_numpy()
                near, s = ix.seeds(ids, vx.matrix(part.column(1), part.num_rows))
                ok = np.isfinite(s)
                own = np.broadcast_to(ids[:, None], s.shape)
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(near[ok]), pa.array(s[ok])], ["query_id", "vec_id", "score"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for qi, qv, fl, ci, cv in zip(*(b.column(k) for k in range(5))):
                ints = lambda x: np.frombuffer(x.as_py(), np.int64)
                mat = lambda x: np.frombuffer(x.as_py(), real).reshape(-1, d).astype(np.float64)
                qid, cid = ints(qi), ints(ci)
                i, j, s = scan(ix, qid, mat(qv), np.frombuffer(fl.as_py(), np.float64), cid, mat(cv), epsilon=epsilon)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(cid[j]), pa.array(s)], ["query_id", "vec_id", "score"])

    # fewer, larger tasks make fuller blocks; no rows move
    blocks = x.coalesce(max(8, n // 65536)).mapInArrow(lean(assign), "list int, ids binary, v binary")
    blocks = materialize(blocks, "lists", wide=True)
    parts = F.broadcast(blocks.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCKS).cast("int").alias("parts")))  # a row for a list
    dealt = blocks.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("ids"), "parts").cast("int"))

    def visit(asked: DataFrame, first: int, last: int) -> DataFrame:
        """What queries (id, v, floor) find in so many of their lists."""
        asks = asked.select("id", "v", "floor").repartition(max(1, n_queries // QUERY_ROWS)).mapInArrow(lean(probe(first, last)), "list int, ids binary, v binary, floor binary")
        asks = asks.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ids").alias("qids"), F.col("v").alias("qv"), "floor")
        both = asks.join(dealt, ["list", "part"]).select("qids", "qv", "floor", "ids", "v")
        with wide_rows(spark):
            return materialize(both.mapInArrow(lean(compare), "query_id long, vec_id long, score double"), "hits")

    def ranked(hits: DataFrame) -> DataFrame:
        best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    least = F.lit(float("-inf"))
    found = visit(queries.withColumn("floor", least), 0, NEAR)
    # thresholds rest on the seed rows, so they belong to what was found
    seeds = materialize(queries.mapInArrow(lean(seed), "query_id long, vec_id long, score double"), "seeds")
    if index.value.probes > NEAR:
        floor = F.when(F.count("*") == top, F.min("score")).otherwise(least).alias("floor")
        floors = ranked(found.unionByName(seeds)).groupBy("query_id").agg(floor)
        again = queries.join(floors, queries["id"] == floors["query_id"], "left").withColumn("floor", F.coalesce("floor", least))
        found = found.unionByName(visit(again, NEAR, index.value.probes))
    return ranked(found.unionByName(seeds) if seeded else found).select("query_id", "rank", "vec_id", "score")


def exact(base: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20) -> DataFrame:
    """The same by probing every list without abandoning: for measuring recall."""
    return search(base, is_query, id_col, vec_col, top, lists=1, epsilon=np.inf)
