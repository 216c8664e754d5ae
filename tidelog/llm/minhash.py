"""MinHash near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: in round r every shingle is hashed to one of t coordinates (for r < t at random, afterwards to coordinate r - t)
with a value in [r, r + 1); a coordinate keeps its least value. Rounds go on until all coordinates are filled, which
2 t rounds guarantee, so that no coordinate is ever empty and two sketches agree in a coordinate with probability equal
to the Jaccard similarity, concentrated as with t independent hash functions, at about one pass over the shingles.

Candidates: documents whose shingle sets are equal are one class. A class joins BANDS buckets of ROWS coordinates.
In every bucket all members are verified against its center, the member that meets most others over all its buckets;
where a bucket then still holds several connected groups, members of different groups are verified against each other.
Pairs that are already connected need no test, as they cannot change a component. Such buckets are cut into parts of
bounded size, which carry the full shingle sets; pairs of parts are compared inside tasks by exact intersection sizes,
products of their incidence matrices, and give out star edges of what is linked, never pairs. Every link is verified on
the full shingle sets.

Edge cases: a text with fewer words than a shingle is one shingle; texts without words (null, empty, blank) have empty
sets and link with nothing; rows with a null id take part in no link, keep a null component and are kept; rows that
share an id are one node; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import components, lean, materialize, slices, small_batches, stars, stored

BANDS, ROWS = 32, 5
#: Members of a part of a bucket, and shingles that its sets hold together, about.
BLOCK, BLOCK_SHINGLES = 256, 131_072

U = np.uint64


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of several sets: an array of len(sets) x t, all ones for empty sets."""
    m = len(sets)
    out = np.full(m * t, ~U(0), U)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out.reshape(m, t)
    owner = np.repeat(np.arange(m), sizes)
    items = np.concatenate(sets)
    for r in range(2 * t):
        h = tk.mix(items + U((0x9E3779B97F4A7C15 * (r + 1)) % 2**64))
        # value: round, then 54 bits; the coordinate comes from other bits of the hash
        at = owner * t + ((h >> U(40)) % U(t)).astype(np.int64) if r < t else owner * t + (r - t)
        np.minimum.at(out, at, (U(r) << U(54)) | (tk.mix(h ^ U(0xA5A5A5A5)) >> U(10)))
        open_ = (out.reshape(m, t) == ~U(0)).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        if not open_[owner].all():
            keep = open_[owner]
            owner, items = owner[keep], items[keep]
    return out.reshape(m, t)


def bands_of(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    h = np.zeros(s.shape[:2], U) + np.arange(bands, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = tk.mix(h ^ s[:, :, j])
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits of the set), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in slices(b.column(1)):
                sets = list(tk.shingle_sets(data, offs, k))
                keys = bands_of(sketch(sets, bands * rows), bands, rows)
                full = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                sign = lambda x: x - (1 << 64) if x >> 63 else x
                empty = np.array([len(s) == 0 for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), pa.array(keys.ravel()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([sign(x >> 64) for x in full], pa.int64()), pa.array([sign(x & (2**64 - 1)) for x in full], pa.int64()), lists],
                    ["doc_id", "n_shingles", "h1", "h2", "bands"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def shingle_sets(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, bands array<long>, own binary: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in slices(b.column(1)):
                sets = list(tk.shingle_sets(data, offs, k))
                keys = bands_of(sketch(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "bands", "own"])

    return texts.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, bands array<long>, own binary")


def intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y; sets are sorted and distinct."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (a, i), (b, j) = flat(x), flat(y)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(shared):
        return out

    def known(h, owner):
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        ok = shared[at] == h
        o = np.argsort(at[ok], kind="stable")
        return at[ok][o], owner[ok][o]

    (a, i), (b, j) = known(a, i), known(b, j)
    for lo in range(0, len(shared), columns):
        n = min(columns, len(shared) - lo)
        one, two = np.zeros((len(x), n), np.float32), np.zeros((len(y), n), np.float32)
        for m, h, owner in ((one, a, i), (two, b, j)):
            s, e = np.searchsorted(h, [lo, lo + n])
            m[owner[s:e], h[s:e] - lo] = 1
        out += (one @ two.T).astype(np.int64)  # at most 4096 a column chunk: exact
    return out


def tiled(rows: DataFrame) -> DataFrame:
    """(key, p, q, right, self, node, n, c): members of mixed buckets, dealt to pairs of bounded parts (tiles).

    rows has (key, node, n, c). Members of a bucket's largest group need no comparison with each other, so only parts of
    the rest, 0 .. least - 1, meet all parts, those of the largest group behind them. A part of the rest is compared
    with itself where it meets the first of these; a bucket of two parts is one tile, in which nothing is repeated.
    """
    most = rows.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("most"))
    rows = rows.join(most, "key").withColumn("main", F.col("c") == F.col("most.c")).drop("most")
    count = lambda m: F.greatest(F.ceil(F.count_if(m) / BLOCK), F.ceil(F.sum(F.when(m, F.least("n", F.lit(BLOCK_SHINGLES))).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    size = rows.groupBy("key").agg(count(~F.col("main")).alias("least"), count(F.col("main")).alias("more"))
    at = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("main"), F.col("more")).otherwise(F.col("least"))).cast("int")
    own = rows.join(size, "key").withColumn("at", at + F.when(F.col("main"), F.col("least")).otherwise(0))
    every = F.sequence(F.lit(0), F.col("least") + F.col("more") - 1)
    tile = lambda p, q, right: F.struct(p.alias("p"), q.alias("q"), F.lit(right).alias("right"))
    left = F.transform(F.filter(every, lambda q: ~F.col("main") & (q > F.col("at"))), lambda q: tile(F.col("at"), q, False))
    right = F.transform(F.filter(every, lambda p: (p < F.col("at")) & (p < F.col("least"))), lambda p: tile(p, F.col("at"), True))
    out = own.select("key", "node", "n", "c", "least", F.explode(F.concat(left, right)).alias("t"))
    return out.select("key", "t.p", "t.q", "t.right", (F.col("t.q") == F.col("least")).alias("self"), "node", "n", "c")


def tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Star edges (u, v) of the links between unlike groups of a bucket: (key, node, n, c) rows, compared tile by tile."""

    def linked(key, x, y, ok):
        ok &= x["c"][:, None] != y["c"][None, :]
        ok &= 100 * np.minimum(x["n"][:, None], y["n"][None, :]) >= percent * np.maximum(x["n"][:, None], y["n"][None, :])
        i, j = np.nonzero(ok)
        mine = np.zeros(len(i), bool)
        for at in range(0, len(i), 8192):  # a pair is met in every bucket it shares and counts in the first
            p, q = i[at : at + 8192], j[at : at + 8192]
            first = (x["bands"][p] == y["bands"][q]).argmax(1)
            mine[at : at + 8192] = x["bands"][p, first] == key
        i, j = i[mine], j[mine]
        if not len(i):
            return i, j
        (p, at), (q, to) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        both = intersections([x["own"][k] for k in p], [y["own"][k] for k in q])[at, to]
        hit = 100 * both >= percent * (x["n"][i] + y["n"][j] - both)
        return x["node"][i[hit]], y["node"][j[hit]]

    def compare(tile, batches):
        rows = pa.Table.from_batches(batches)
        sides = []
        for right in (False, True):
            own = rows.filter(pa.compute.equal(rows.column("right"), right)).combine_chunks()
            get = lambda name: own.column(name).to_numpy()  # noqa: B023, E731
            bands = own.column("bands").combine_chunks()
            sides.append({"node": get("node"), "n": get("n"), "c": get("c"), "bands": bands.flatten().to_numpy().reshape(len(own), -1 if len(own) else 0), "own": [np.frombuffer(x.as_buffer(), U) for x in own.column("own")]})
        x, y = sides
        found = [linked(tile[0], x, y, np.ones((len(x["n"]), len(y["n"])), bool))] if len(x["n"]) and len(y["n"]) else []
        if tile[3] and len(x["n"]) > 1:
            found.append(linked(tile[0], x, x, np.triu(np.ones((len(x["n"]),) * 2, bool), 1)))
        u, v = (np.concatenate(k) if found else np.zeros(0, np.int64) for k in (zip(*found) if found else ((), ())))
        if len(u):
            u, v = stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            tiles = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            cut = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for a, e in zip(cut[:-1], cut[1:]):
                if e > a:
                    if now != (tile := tuple(tiles[a].tolist())) and held:
                        yield compare(now, held)
                        held = []
                    now = tile
                    held.append(b.slice(a, e - a))
        if held:
            yield compare(now, held)

    full = tiled(rows).join(sets.select(F.col("doc_id").alias("node"), "bands", "own"), "node")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.select("key", "p", "q", "self", "right", "node", "n", "c", "bands", "own").repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(lean(run), "u long, v long").where("u <> v")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # successive pairs share b
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = np.zeros(len(a), bool)
            for at, data, offs in slices(batch.column(2)):
                for j, s in enumerate(tk.shingle_sets(data, offs, k)):
                    i = at + j
                    if last[0] != b[i]:
                        raw = (batch.column(3)[i].as_py() or "").encode()
                        last = (b[i], next(tk.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k)))
                    both = len(np.intersect1d(s, last[1], assume_unique=True))
                    ok[i] = both > 0 and 100 * both >= percent * (len(s) + len(last[1]) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["u", "v"])

    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "tb")
    full = full.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(lean(run), "u long, v long")


@stored("classes")
def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    sig = materialize(signatures(docs, k, bands, rows), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    # one node per distinct set; a node's id is the least document id that has the set
    nodes = materialize(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    put = nodes.select("node", "n", F.explode("bands").alias("key"))
    many = put.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    member = materialize(put.join(many, "key").select("key", "node", "n", "m"), "members")
    degree = member.groupBy("node").agg(F.sum("m").alias("degree"))
    chosen = member.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("less"), "n")).alias("c"))
    starred = member.join(chosen.select("key", (-F.col("c.less")).alias("center"), F.col("c.n").alias("nb")), "key")
    near = F.expr(f"100 * least(n, nb) >= {percent} * greatest(n, nb)")
    star = starred.where("node <> center").where(near).select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    star = materialize(star, "pairs")

    def texts(ids: DataFrame) -> DataFrame:
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return src.join(_hint(ids), "doc_id", "left_semi")

    need = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    links = materialize(verify(star, texts(need), k, percent).distinct(), "links")
    part = components(links)
    named = member.join(part, member.node == part.node, "left").select("key", member.node, "n", F.coalesce("component", member.node).alias("c"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = materialize(named.join(mixed, "key"), "mixed")
    if not rest.isEmpty():
        sets = materialize(shingle_sets(texts(rest.select(F.col("node").alias("doc_id")).distinct()), k, bands, rows), "sets")
        more = materialize(tile_links(rest, sets, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            part = components(links)
    # joined by set, and by repeated ids
    # distinct first: what the joins below give needs no grouping, so adaptive execution may split a set that many have
    ids = full.select("doc_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    twice = ids.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w")
    if not twice.isEmpty():
        every = ids.join(twice.select("doc_id"), "doc_id").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
        part = components(links.unionByName(every))
    found = ids.join(part, "node", "left").select("doc_id", "h1", "h2", F.coalesce("component", "node").alias("c"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(found, ["doc_id", "h1", "h2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _hint(ids: DataFrame, bound: int = 250_000) -> DataFrame:
    """Broadcasts a set of ids only after counting that it has at most `bound` rows (8 bytes each)."""
    ids = materialize(ids, "ids")
    return F.broadcast(ids) if ids.count() <= bound else ids
