"""Exact substring deduplication with a deep-shallow sort of sampled suffixes.

A byte goes if a window of `length` bytes that covers it also starts anywhere else. Suffixes are sampled, not listed:
of the K-byte strings in a window the one with the least hash (the leftmost of equals) is the window's anchor, which
depends on the window's content alone. Equal windows therefore have equal anchors at equal places, and every window
belongs to exactly one anchor, about one in (length - K) / 2 positions.

1. Each text's anchors are listed with the windows they stand for and a hash of the stretch those windows cover.
2. A stretch that occurs twice makes all its windows repeats. An anchor with a single stretch has no repeats.
3. The distinct stretches of the other anchors are compared: their suffixes at the anchor, and the reversed prefixes
   before it, are sorted by multikey quicksort over 8-byte keys to a shallow depth, and groups that still tie by
   inserting them in a blind trie, which looks at a few branching positions and verifies one string. With both orders
   and their common-prefix lengths, windows that start l bytes before the anchor are equal exactly where l bytes to the
   left and length - l bytes to the right agree; this is decided for every l at once for all anchors of a task.
4. An anchor with more than GROUP distinct stretches is not sorted in one task: its windows are compared by their
   128-bit hashes, counted in a shuffle that combines on the map side. This is exact and has no hot task.

Texts are told apart by 128 bits of hash, so repeated rows, repeated or null ids need no care: equal texts have equal
answers. Null and empty texts, and texts shorter than `length`, lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import lean, materialize, slices, small_batches, stored

LENGTH, K = 400, 64
#: Distinct stretches of one anchor that a task sorts together: at most GROUP * (2 * length) bytes.
GROUP = 20_000
#: Stretches gathered before a task sorts them.
BATCH = 30_000
SHALLOW = 64

U = np.uint64


# ---- anchors ----------------------------------------------------------------------------------------------------


#: Starts that are looked at together: their positions, and a window's width, fit 28 bits.
STARTS = 1 << 27


def least_positions(g: np.ndarray, w: int) -> np.ndarray:
    """For every start s the position of the least of g[s : s + w], the leftmost of equals."""
    n = len(g) - w + 1
    if n > STARTS:
        return np.concatenate([least_positions(g[at : at + min(STARTS, n - at) + w - 1], w) + at for at in range(0, n, STARTS)])
    packed = (g & ~U(0xFFFFFFF)) | np.arange(len(g), dtype=U)  # 36 bits of hash, 28 of position
    pad = -len(g) % w
    p = np.concatenate([packed, np.full(pad, ~U(0), U)]).reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & U(0xFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """(document, anchor hash, anchor, first window, last window) over a slice; positions are in the slice."""
    n = len(data)
    ok = np.diff(offs) >= length
    none = np.zeros(0, np.int64)
    if n < length or not ok.any():
        return none, none.astype(U), none, none, none
    h = tk.prefix_hash(data)
    at = np.arange(n - k + 1)
    g = tk.span_hash(h, at, at + k)
    pos = least_positions(g, length - k + 1)
    # windows that lie within one document
    last = np.repeat(offs[1:] - length, np.diff(offs))[: len(pos)]
    start = np.flatnonzero(np.arange(len(pos)) <= last)
    p = pos[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(p)) - 1
    return np.searchsorted(offs, start[first], "right") - 1, g[p[first]], p[first], start[first], start[end]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, data, offs in slices(b.column(2)):
                doc, g, p, lo, hi = anchors(data, offs, length, k)
                if not len(doc):
                    continue
                raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
                ch = np.fromiter((digest(raw[a : e + length], seed=s) for a, e, s in zip(lo.tolist(), hi.tolist(), (p - lo).tolist())), U, len(lo))
                base = offs[doc]
                cols = [t1[row + doc], t2[row + doc], g.view(np.int64), ch.view(np.int64), p - base, lo - base, hi - base]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "ah", "ch", "p", "lo", "hi"])

    return run


# ---- the sort ---------------------------------------------------------------------------------------------------


def shallow_sort(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of fixed-width byte rows, 8 bytes a key, to `depth`: (order, common bytes with the row before).

    Common bytes are exact below depth; `depth` means that the rows tie so far.
    """
    m = len(rows)
    order, group, lcp = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    tied = np.ones(m, bool)  # with the row before; the first row's is unused
    for at in range(0, depth, 8):
        if not tied[1:].any():
            break
        live = np.flatnonzero(np.concatenate([tied[1:], [False]]) | (tied & (np.arange(m) > 0)))
        part = np.zeros((len(live), 8), np.uint8)
        cut = rows[order[live], at : at + 8]
        part[:, : cut.shape[1]] = cut
        key = part.view(">u8").ravel().astype(U)
        o = np.lexsort((key, group[live]))
        order[live] = order[live][o]
        key, own = key[o], group[live][o]
        same = own[1:] == own[:-1]
        differ = key[1:] ^ key[:-1]
        # leading equal bytes of the two keys
        bytes_ = np.full(len(differ), 8, np.int64)
        nz = differ != 0
        bytes_[nz] = (63 - np.floor(np.log2(differ[nz].astype(np.float64)) + 1e-12).astype(np.int64)) // 8
        for j in range(8):  # exact at the borders of the floating logarithm
            bytes_[nz & ((differ >> U(56 - 8 * j)) != 0)] = np.minimum(bytes_[nz & ((differ >> U(56 - 8 * j)) != 0)], j)
        i = live[1:][same]
        lcp[i] = at + bytes_[same]
        tied[i] = ~nz[same]
        group = np.cumsum(~tied)
    lcp[0] = 0
    return order, np.minimum(lcp, depth)


class BlindTrie:
    """Patricia trie of equal-length byte strings held as integers; strings differ in the first byte where they part."""

    def __init__(self, width: int):
        self.width, self.root = width, None

    def common(self, a: int, b: int) -> int:
        return self.width - ((a ^ b).bit_length() + 7) // 8

    def insert(self, name: int, value: int) -> None:
        if self.root is None:
            self.root = [value, [name]]
            return
        width = self.width
        node = self.root  # blind descent: only branching bytes are looked at
        while len(node) == 3:
            depth, kids, _ = node
            node = kids.get((value >> 8 * (width - 1 - depth)) & 255) or next(iter(kids.values()))
        at = self.common(value, node[0])
        if at == width:
            node[1].append(name)
            return
        old = (node[0] >> 8 * (width - 1 - at)) & 255
        parent, key, node = None, 0, self.root
        while len(node) == 3 and node[0] < at:
            parent, key = node, (value >> 8 * (width - 1 - node[0])) & 255
            node = node[1][key]
        new = (value >> 8 * (width - 1 - at)) & 255
        if len(node) == 3 and node[0] == at:
            node[1][new] = [value, [name]]
            return
        fork = [at, {old: node, new: [value, [name]]}, None]
        if parent is None:
            self.root = fork
        else:
            parent[1][key] = fork

    def walk(self) -> Iterator[tuple[int, int]]:
        """(name, common bytes with the name before) in order."""
        stack, lcp = [(self.root, 0)], 0
        while stack:
            node, lcp = stack.pop()
            if len(node) == 3:
                depth, kids, _ = node
                keys = sorted(kids)
                stack += [(kids[c], depth) for c in reversed(keys[1:])]
                stack.append((kids[keys[0]], lcp))
            else:
                for j, name in enumerate(node[1]):
                    yield name, self.width if j else lcp


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte rows of one width: (order, common bytes of each with the one before)."""
    m, width = rows.shape
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, lcp = shallow_sort(rows, min(shallow, width))
    if width <= shallow:
        return order, lcp
    tied = lcp >= shallow
    tied[0] = False
    starts = np.flatnonzero(~tied)
    ends = np.append(starts[1:], m)
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a < 2:
            continue
        trie = BlindTrie(width)
        for name in order[a:b].tolist():
            trie.insert(name, int.from_bytes(rows[name].tobytes(), "big"))
        own, keep = lcp[a], []
        for j, (name, common) in enumerate(trie.walk()):
            keep.append(name)
            lcp[a + j] = common if j else own
        order[a:b] = keep
    return order, lcp


def repeated_windows(texts: list[bytes], before: np.ndarray, count: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Which windows occur in more than one stretch: bool[stretch, l], l the bytes between window start and anchor.

    A stretch is texts[i], its anchor at before[i], its windows start at 0 .. count[i] - 1.
    """
    m, span = len(texts), length - k + 1
    right = np.zeros((m, length), np.uint8)
    left = np.zeros((m, span), np.uint8)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        b = int(before[i])
        r = raw[b : b + length]
        right[i, : len(r)] = r
        if b:
            left[i, : min(b, span)] = raw[:b][::-1][:span]
    ro, rl = deep_shallow(right)
    lo, ll = deep_shallow(left)
    out = np.zeros((m, span), bool)
    for l in range(span):
        own = np.flatnonzero((before >= l) & (before - l < count))
        if len(own) < 2:
            continue
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[ro] = np.cumsum(rl < length - l)
        b[lo] = np.cumsum(ll < l) if l else 0
        both = a[own] * (m + 1) + b[own]
        o = np.argsort(both, kind="stable")
        s = both[o]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[own[o[hit]], l] = True
    return out


def _sort_rows(length: int, k: int, batch: int):
    """Rows (ah, ch, p, stretch) with all rows of an anchor in succession -> (ah, ch, windows lo, hi) relative to the stretch."""

    def ranges(ah, ch, before, texts):
        before = np.array(before, np.int64)
        count = np.array([len(t) - length + 1 for t in texts], np.int64)
        hit = repeated_windows(texts, before, count, length, k)
        got: list[list] = [[], [], [], []]
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            starts = np.sort(before[i] - np.flatnonzero(hit[i]))
            cut = np.flatnonzero(np.diff(starts) > 1)
            for a, e in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()):
                for c, v in zip(got, (ah[i], ch[i], a, e)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["ah", "ch", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ah, ch, before, texts, seen = [], [], [], [], None
        for b in batches:
            for a, c, p, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if a != seen and len(texts) >= batch:
                    yield ranges(ah, ch, before, texts)
                    ah, ch, before, texts = [], [], [], []
                if ah and a == ah[-1] and c == ch[-1]:
                    continue  # the same stretch from a repeated text
                seen = a
                ah.append(a), ch.append(c), before.append(p), texts.append(t)
        if texts:
            yield ranges(ah, ch, before, texts)

    return run


def _window_rows(length: int):
    """(ah, ch, p, stretch) -> (w1, w2, ah, ch, lo) of every window of the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                n = len(t) - length + 1
                full = [xxhash.xxh3_128_intdigest(t[i : i + length]) for i in range(n)]
                cols = [[signed(x >> 64) for x in full], [signed(x & (2**64 - 1)) for x in full], [a] * n, [c] * n, list(range(n))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["w1", "w2", "ah", "ch", "lo"])

    return run


# ---- the whole --------------------------------------------------------------------------------------------------

_T1, _T2 = F.xxhash64, lambda c: F.xxhash64(F.lit(1), c)


@stored("ranges")
def repeated_ranges(texts: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """(t1, t2, spans array<struct<lo, hi>>): byte ranges to remove, by text; texts has (t1, t2, text)."""
    found = materialize(texts.mapInArrow(lean(_anchor_rows(length, k)), "t1 long, t2 long, ah long, ch long, p long, lo long, hi long"), "anchors")
    # (anchor, stretch): how often, and one place to read it from
    each = found.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "lo", "hi", "p")).alias("at"))
    # an anchor that occurs once needs nothing more; of the others, how many distinct stretches
    of = each.groupBy("ah").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1")
    each = materialize(each.join(of, "ah").select("ah", "ch", "n", "kinds", "at"), "stretches")
    open_ = each.where("kinds > 1").select("ah", "ch", "kinds", "at.*")
    carriers = open_.select("t1", "t2").distinct()
    carriers = materialize(carriers, "carriers")
    few = F.broadcast(carriers) if carriers.count() <= 250_000 else carriers  # 16 bytes a row
    here = texts.join(few, ["t1", "t2"], "left_semi")
    todo = open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("ah", "ch", "kinds", "lo", "hi", "p")).alias("todo"))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, own in zip(b.column(0), b.column(1)):
                raw = text.as_py().encode()
                rows = own.as_py()
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    cols = [[r[x] for r in part] for x in ("ah", "ch", "kinds")] + [[r["p"] - r["lo"] for r in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([raw[r["lo"] : r["hi"] + length] for r in part], pa.binary())], ["ah", "ch", "kinds", "p", "stretch"])

    ready = here.join(todo, ["t1", "t2"]).select("text", "todo").mapInArrow(lean(cut), "ah long, ch long, kinds long, p long, stretch binary")
    ready = materialize(ready, "open")
    narrow = ready.where(F.col("kinds") <= group).select("ah", "ch", "p", "stretch")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = narrow.repartition(n, "ah").sortWithinPartitions("ah", "ch").mapInArrow(lean(_sort_rows(length, k, BATCH)), "ah long, ch long, lo long, hi long")
    wide = ready.where(F.col("kinds") > group).dropDuplicates(["ah", "ch"]).select("ah", "ch", "p", "stretch")
    windows = wide.mapInArrow(lean(_window_rows(length)), "w1 long, w2 long, ah long, ch long, lo long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    hashed = windows.join(twice, ["w1", "w2"]).select("ah", "ch", "lo", F.col("lo").alias("hi"))
    partial = sorted_.unionByName(hashed) if not wide.isEmpty() else sorted_
    partial = materialize(partial, "partial").withColumnsRenamed({"lo": "a", "hi": "e"})
    once = each.where("n = 1 and kinds > 1").select("ah", "ch", "at.*").join(partial, ["ah", "ch"])
    some = once.select("t1", "t2", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("e") + length).alias("hi"))
    whole = found.join(each.where("n > 1").select("ah", "ch"), ["ah", "ch"]).select("t1", "t2", "lo", (F.col("hi") + length).alias("hi"))
    # repeated texts have equal rows; what remains is bounded by a text's length
    return some.unionByName(whole).distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["lo"] <= out[-1][1]:
            if s["hi"] > out[-1][1]:
                out[-1] = (out[-1][0], s["hi"])
        else:
            out.append((s["lo"], s["hi"]))
    return out


def _keyed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep or [])]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *own).withColumns({"t1": _T1("text"), "t2": _T2("text")})


def with_ranges(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, text, spans (merged by the reader) and the kept columns as _0, _1, ...; one row per row of docs."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, keep)
    ranges = repeated_ranges(_keyed(docs).select("t1", "t2", "text"), length, k, group)
    return keyed.join(ranges, ["t1", "t2"], "left").drop("t1", "t2")


def digest_of(raw: bytes, spans: list[dict] | None) -> tuple[int, int, int, str]:
    """Bytes, bytes removed, maximal runs of these, and the digest of what is left of a text."""
    gone = merged(spans)
    at, sha = 0, hashlib.sha256()
    for lo, hi in gone:
        sha.update(raw[at:lo])
        at = hi
    sha.update(raw[at:])
    return len(raw), sum(hi - lo for lo, hi in gone), len(gone), sha.hexdigest()


def digest(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest_of(text.as_py().encode(), own.as_py()) for text, own in zip(b.column(1), b.column(2))]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(docs, None, length, k, group).select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
