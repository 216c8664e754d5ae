"""Packing of tokenised documents into fixed windows by non-negative least squares over the length histogram.

Documents longer than the window are cut into full windows and a rest. The rests' lengths, rounded up to a unit, form a
histogram; its size depends on the window alone. All combinations of up to three lengths that fill a window are
columns of a matrix; non-negative least squares finds how often each is to be used, the counts are rounded down, and
what they leave over is packed best-fit over the same histogram. The resulting plan (combination, repeats) is a small
table. Documents meet it by their rank within their length, counted with a prefix sum over hash shards, so that a
length that a third of all documents share is ranked in many tasks.

Edge cases: a null or empty text is one piece holding the end token only; repeated rows are packed as often as they
occur; null ids are allowed; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .base import lean, materialize, small_batches

WINDOW = 2048
UNIT = 8
SHARDS = 64


# ---- the plan -------------------------------------------------------------------------------------------------


def combinations(units: int) -> list[tuple[int, ...]]:
    """All multisets of one to three positive lengths that fill exactly `units`."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(a, units - a) for a in range(units - 1, (units - 1) // 2, -1)]
    for a in range(units - 2, 0, -1):
        for b in range(min(a, units - a - 1), 0, -1):
            c = units - a - b
            if c <= b:
                out.append((a, b, c))
    return out


def nnls(a: np.ndarray, b: np.ndarray, max_steps: int | None = None, tol: float = 1e-9) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |a x - b|."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    w = a.T @ b
    for _ in range(max_steps or 3 * m):
        free = np.where(passive, -np.inf, w)
        j = int(np.argmax(free))
        if not np.isfinite(free[j]) or free[j] <= tol * scale:
            break
        passive[j] = True
        while True:
            idx = np.flatnonzero(passive)
            own = a[:, idx]
            s = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(idx)), own.T @ b)
            if s.size == 0 or s.min() > 0:
                break
            low = s <= 0
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300))
            x[idx] += step * (s - x[idx])
            gone = idx[x[idx] <= 1e-12 * scale]
            gone = gone if gone.size else idx[low][:1]
            x[gone] = 0
            passive[gone] = False
        x[:] = 0
        x[np.flatnonzero(passive)] = s
        w = a.T @ (b - a @ x)
    return x


def best_fit(counts: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Greedy packing over a histogram: longest first, into the fullest open group that has room.

    Works on whole groups of equal bins, so its steps are bounded by lengths, not by documents.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # free units -> (content, how many)
    for size in range(units, 0, -1):
        left = int(counts[size])
        while left:
            free = min((r for r in room if r >= size), default=0)
            if not free:
                # fill fresh bins with as many of this length as fit; a last bin takes what is over
                per = units // size
                full, over = divmod(left, per)
                if full:
                    room.setdefault(units - per * size, []).append(((size,) * per, full))
                if over:
                    room.setdefault(units - over * size, []).append(((size,) * over, 1))
                break
            content, many = room[free].pop()
            per = free // size  # of this length, how many one of these bins takes
            bins = min(many, max(1, left // per))
            put = min(per, left)
            if many > bins:
                room[free].append((content, many - bins))
            if not room[free]:
                del room[free]
            room.setdefault(free - put * size, []).append((content + (size,) * put, bins))
            left -= bins * put
    return [x for groups in room.values() for x in groups]


def plan(counts: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a window, repeats), together using every length exactly counts[length] times."""
    left = counts.astype(np.int64).copy()
    out = []
    if left[1:].sum():
        combos = combinations(units)
        a = np.zeros((units, len(combos)))
        for j, c in enumerate(combos):
            for size in c:
                a[size - 1, j] += 1
        for j in np.argsort(-(x := nnls(a, left[1:].astype(float)))):
            need = np.bincount(combos[j], minlength=units + 1)
            used = need > 0
            n = int(min(np.floor(x[j] + 1e-6), (left[used] // need[used]).min()))
            if x[j] <= 0:
                break
            if n > 0:
                left -= n * need
                out.append((combos[j], n))
    return out + best_fit(left, units)


def slots(packing: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, last rank, first sequence, per sequence, slot): which ranks of a length go to which windows."""
    rank: dict[int, int] = {}
    out, seq = [], 0
    for content, n in packing:
        slot = 0
        for size in dict.fromkeys(content):
            per = content.count(size)
            lo = rank.get(size, 0)
            out.append((size, lo, lo + per * n - 1, seq, per, slot))
            rank[size] = lo + per * n
            slot += per
        seq += n
    return out


# ---- pieces ---------------------------------------------------------------------------------------------------

_fast: dict[int, object] = {}


#: The compiled library's patterns recurse over a run of white space; longer ones overflow its stack.
GAP = re.compile(r"\s{4096}")


def _fast_encoder(content: bytes):
    """The same vocabulary in a compiled library; texts that it can't take go to the encoder of bpe.py."""
    key = hash(content)
    if key not in _fast:
        import tiktoken

        enc = bpe.encoder(content)
        ranks = {t: i for i, t in enumerate(enc.tokens) if i not in enc.special.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _fast[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _fast[key]


def tokenize(content: bytes, text: str) -> np.ndarray:
    """The ids that the tokenizers library gives, as little-endian unsigned 32-bit integers."""
    enc = bpe.encoder(content)
    if GAP.search(text) or (enc.special_re is not None and enc.special_re.search(text)):
        return np.frombuffer(enc.encode(text), "<u4")
    return np.array(_fast_encoder(content).encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, vocab_path: str, window: int = WINDOW, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): each document's ids and end token, cut at the window."""
    vocab = bpe.vocabulary(docs, vocab_path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                cols: list[list] = [[] for _ in names]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.append(tokenize(vocab.value, text.as_py() or ""), np.array(end_id, "<u4"))
                    for at in range(0, len(ids), window):
                        cut = ids[at : at + window]
                        row = (doc, at, len(cut), zlib.crc32(cut.tobytes()), len(ids), *([cut.astype("<i4")] * keep_ids))
                        for c, v in zip(cols, row):
                            c.append(v)
                types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return src.mapInArrow(lean(run), schema)


def pack(made: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (any other columns are kept). Reads `made` three times: pass a stored table."""
    units = window // unit
    spark = made.sparkSession
    # Equal rows are interchangeable, so a shard's rows may be ranked in any order that its task gives them.
    salted = made.withColumns({
        "_bin": F.ceil(F.col("length") / unit).cast("int"),
        "_shard": F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(SHARDS)).cast("int"),
    })
    per = salted.groupBy("_bin", "_shard").agg(F.count("*").alias("n"))
    rows = per.collect()  # lengths x shards at most: its size does not follow the input
    counts = np.zeros(units + 1, np.int64)
    for r in rows:
        counts[r["_bin"]] += r["n"]
    table = slots(plan(counts, units))
    base, running = [], {}
    for r in sorted(rows, key=lambda r: (r["_bin"], r["_shard"])):
        base.append((r["_bin"], r["_shard"], running.get(r["_bin"], 0)))
        running[r["_bin"]] = base[-1][2] + r["n"]
    # Both tables are bounded by the window: lengths x shards, and plan entries.
    base_df = spark.createDataFrame(base, "_bin int, _shard int, _base long")
    lookup = spark.sparkContext.broadcast(_lookup(table, units))
    order = Window.partitionBy("_bin", "_shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.join(F.broadcast(base_df), ["_bin", "_shard"]).withColumn("_rank", F.row_number().over(order) - 1 + F.col("_base"))

    @F.arrow_udf("sequence long, slot long")  # only these two columns travel to Python
    def place(bins: pa.Array, ranks: pa.Array) -> pa.Array:
        seq, slot = lookup.value(bins.to_numpy(), ranks.to_numpy())
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(slot)], ["sequence", "slot"])

    placed = ranked.withColumn("_at", place("_bin", "_rank")).select(*made.columns, F.col("_at.sequence").alias("sequence_id"), F.col("_at.slot").alias("_slot"))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_slot")


class _lookup:
    """Finds (sequence, slot) of (length bin, rank) arrays."""

    def __init__(self, table, units: int):
        self.by = {}
        for size in range(1, units + 1):
            own = sorted(x[1:] for x in table if x[0] == size)
            if own:
                self.by[size] = np.array(own, np.int64)

    def __call__(self, bins: np.ndarray, ranks: np.ndarray):
        seq, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        for size in np.unique(bins):
            m = np.flatnonzero(bins == size)
            t = self.by[int(size)]
            r = ranks[m]
            k = np.searchsorted(t[:, 0], r, "right") - 1
            at = r - t[k, 0]
            seq[m] = t[k, 2] + at // t[k, 3]
            slot[m] = t[k, 4] + at % t[k, 3]
        return seq, slot


def pack_documents(docs: DataFrame, vocab_path: str, window: int = WINDOW, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack a corpus; one row per piece. The ids, if kept, meet their places in one join."""
    small_batches(docs.sparkSession)
    made = pieces(docs, vocab_path, window, keep_ids=keep_ids)
    if not keep_ids:
        return pack(materialize(made, "pieces"), window, unit)
    made = materialize(made.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    return pack(made.drop("ids"), window, unit).join(made.select("_piece", "ids"), "_piece").drop("_piece")
