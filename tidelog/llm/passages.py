"""Passages of at least `WORDS` successive words that occur more than once, wherever their line breaks lie.

Words are what white space parts (that of Unicode too), compared byte for byte. Windows of WORDS words are sampled by
anchors as in suffix_dedup, with hashes of words in place of bytes: every window belongs to the least K-word hash in
it, and equal windows have equal anchors. A stretch of words that occurs twice makes all its windows repeats; the
distinct stretches of another anchor meet in a task, which compares their windows by 128-bit hashes. Those of an anchor
with more than GROUP distinct stretches are compared by the same hashes in a shuffle that combines on the map side, so
that no task holds them all. Every window is compared: nothing is capped. As in suffix_dedup all copies are found, the
first one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_dedup
from . import textkit as tk
from .base import lean, materialize, slices, small_batches, stored

#: "over 50 words"
WORDS, K = 51, 16
#: Distinct stretches of an anchor that one task compares, and bytes of stretches that it takes at once, about.
GROUP, TAKE = 20_000, 1 << 22

U = np.uint64
_ASCII = np.zeros(256, bool)
_ASCII[[*range(9, 14), *range(28, 33)]] = True
#: Three-byte white space: U+1680, U+2000 .. U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space, as str.split() has it."""
    out = _ASCII[data]
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[(data[at + 1] == 0x85) | (data[at + 1] == 0xA0)]
    out[at] = out[at + 1] = True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else at[:0]
    code = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    at = at[np.isin(code, _WIDE)]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def tokens(data: np.ndarray, offs: np.ndarray):
    """Words of each document: (hashes, starts, ends, first word of each document and the total)."""
    inside = ~spaces(data)
    n = len(data)
    edge = offs[(offs > 0) & (offs < n)]
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    prev[edge] = False
    starts = np.flatnonzero(inside & ~prev)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    stop[edge - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    return tk.span_hash(tk.prefix_hash(data), starts, ends), starts, ends, np.searchsorted(starts, offs)


def anchors(w: np.ndarray, first: np.ndarray, words: int, k: int):
    """(document, anchor hash, anchor, first window, last window); positions are words of the slice."""
    none = np.zeros(0, np.int64)
    if not (np.diff(first) >= words).any():
        return none, none.astype(U), none, none, none
    g = tk.ngram_hash(w, k)
    pos = suffix_dedup.least_positions(g, words - k + 1)
    last = np.repeat(first[1:] - words, np.diff(first))[: len(pos)]
    start = np.flatnonzero(np.arange(len(pos)) <= last)
    p = pos[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    end = np.append(head[1:], len(p)) - 1
    return np.searchsorted(first, start[head], "right") - 1, g[p[head]], p[head], start[head], start[end]


def _anchor_rows(words: int, k: int):
    """(t1, t2, text) -> its stretches: bytes lo .. hi hold words of which the windows start at words a .. e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, data, offs in slices(b.column(2)):
                w, starts, ends, first = tokens(data, offs)
                doc, g, p, a, e = anchors(w, first, words, k)
                if not len(doc):
                    continue
                raw, digest = memoryview(np.ascontiguousarray(w)).cast("B"), xxhash.xxh3_64_intdigest
                ch = np.fromiter((digest(raw[8 * x : 8 * (y + words)], seed=s) for x, y, s in zip(a.tolist(), e.tolist(), (p - a).tolist())), U, len(a))
                base = offs[doc]
                cols = [t1[row + doc], t2[row + doc], g.view(np.int64), ch.view(np.int64), starts[a] - base, ends[e + words - 1] - base]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "ah", "ch", "lo", "hi"])

    return run


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, todo) -> (ah, kinds, t1, t2, lo, stretch), a row for each of todo."""
    for b in batches:
        for t1, t2, text, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            raw, own = text.as_py().encode(), todo.as_py()
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                n = len(part)
                cols = [[x[c] for x in part] for c in ("ah", "kinds")] + [[t1] * n, [t2] * n, [x["lo"] for x in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([raw[x["lo"] : x["hi"]] for x in part], pa.binary())], ["ah", "kinds", "t1", "t2", "lo", "stretch"])


def _windows(stretches: pa.Array, words: int):
    """Windows of a column of stretches: (first words, their stretches, 128-bit hashes as two arrays, starts, ends)."""
    col = stretches.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    w, starts, ends, first = tokens(data, offs - offs[0])
    own = np.repeat(np.arange(len(col)), np.diff(first))
    at = np.flatnonzero(own[words - 1 :] == own[: len(own) - words + 1])
    return at, own[at], tk.ngram_hash(w, words)[at], tk.ngram_hash(tk.mix(w + U(words)), words)[at], starts - (offs[own] - offs[0]), ends - (offs[own] - offs[0])


def _compare(words: int):
    """(ah, t1, t2, lo, stretch) with all rows of an anchor in succession -> (t1, t2, lo, hi) of what occurs twice."""

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        ah, t1, t2, base = (rows.column(c).to_numpy() for c in range(4))
        at, own, h1, h2, starts, ends = _windows(rows.column(4).combine_chunks(), words)
        o = np.lexsort((h2, h1, ah[own]))
        same = (ah[own][o][1:] == ah[own][o][:-1]) & (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])
        hit = np.zeros(len(o), bool)
        hit[o[1:][same]] = hit[o[:-1][same]] = True
        at, own = at[hit], own[hit]
        # successive windows of a stretch are one range
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at)) - 1 if len(at) else head
        k = own[head]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (t1[k], t2[k], base[k] + starts[at[head]], base[k] + ends[at[last] + words - 1])], ["t1", "t2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, None
        for b in batches:
            ah = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(ah[1:] != ah[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi > lo:
                    if size >= TAKE and ah[lo] != seen:
                        yield repeats(pa.Table.from_batches(held))
                        held, size = [], 0
                    part = b.slice(lo, hi - lo)
                    held.append(part)
                    size += part.column(4).nbytes
                    seen = ah[lo]
        if held:
            yield repeats(pa.Table.from_batches(held))

    return run


def _window_rows(words: int):
    """(t1, t2, lo, stretch) -> (w1, w2, t1, t2, lo, hi) of every window of the stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                t1, t2, base = (part.column(c).to_numpy() for c in range(3))
                i, own, h1, h2, starts, ends = _windows(part.column(3), words)
                cols = [h1.view(np.int64), h2.view(np.int64), t1[own], t2[own], base[own] + starts[i], base[own] + ends[i + words - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "t1", "t2", "lo", "hi"])

    return run


@stored("passages")
def repeated_passages(texts: DataFrame, words: int = WORDS, k: int = K, group: int = GROUP) -> DataFrame:
    """(t1, t2, spans array<struct<lo, hi>>): byte ranges of repeated passages, by text; texts has (t1, t2, text)."""
    found = materialize(texts.mapInArrow(lean(_anchor_rows(words, k)), "t1 long, t2 long, ah long, ch long, lo long, hi long"), "passage_anchors")
    each = found.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "lo", "hi")).alias("at"))
    of = each.groupBy("ah").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1")
    each = materialize(each.join(of, "ah").select("ah", "ch", "n", "kinds", "at"), "passage_stretches")
    todo = each.where("kinds > 1").groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("ah", "kinds", "at.lo", "at.hi")).alias("todo"))  # of one text
    rows = texts.join(todo, ["t1", "t2"]).select("t1", "t2", "text", "todo").mapInArrow(lean(_stretch_rows), "ah long, kinds long, t1 long, t2 long, lo long, stretch binary")
    rows = materialize(rows, "passage_open")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.where(F.col("kinds") <= group).select("ah", "t1", "t2", "lo", "stretch").repartition(n, "ah").sortWithinPartitions("ah")
    some = near.mapInArrow(lean(_compare(words)), "t1 long, t2 long, lo long, hi long")
    wide = rows.where(F.col("kinds") > group)
    if not wide.isEmpty():
        windows = materialize(wide.select("t1", "t2", "lo", "stretch").mapInArrow(lean(_window_rows(words)), "w1 long, w2 long, t1 long, t2 long, lo long, hi long"), "passage_windows")
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        some = some.unionByName(windows.join(twice, ["w1", "w2"], "left_semi").select("t1", "t2", "lo", "hi"))
    whole = found.join(each.where("n > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("t1", "t2", "lo", "hi")
    return some.unionByName(whole).distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def with_ranges(docs: DataFrame, keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """As suffix_dedup.with_ranges, with the ranges of repeated passages besides those of repeated byte strings."""
    small_batches(docs.sparkSession)
    texts = suffix_dedup._keyed(docs).select("t1", "t2", "text")
    strings = suffix_dedup.repeated_ranges(texts)
    ranges = strings.unionByName(repeated_passages(texts, words))
    both = ranges.groupBy("t1", "t2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # two a text
    return suffix_dedup._keyed(docs, keep).join(both, ["t1", "t2"], "left").drop("t1", "t2")


def digest(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """suffix_dedup.digest of every row, and n_passage_bytes: how many of its bytes repeated passages cover.

    Passages are reported, not removed here: what is left is told of repeated byte strings alone.
    """
    small_batches(docs.sparkSession)
    texts = suffix_dedup._keyed(docs).select("t1", "t2", "text")
    strings = suffix_dedup.repeated_ranges(texts)
    found = repeated_passages(texts, words).withColumnRenamed("spans", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, passages in zip(b.column(1), b.column(2), b.column(3)):
                rows.append((*suffix_dedup.digest_of(text.as_py().encode(), spans.as_py()), sum(hi - lo for lo, hi in suffix_dedup.merged(passages.as_py()))))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            ints = [pa.array(c, pa.int64()) for c in (*cols[:3], cols[4])]
            yield pa.RecordBatch.from_arrays([b.column(0), *ints[:3], pa.array(cols[3], pa.string()), ints[3]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    both = strings.join(found, ["t1", "t2"], "full_outer")
    rows = suffix_dedup._keyed(docs).join(both, ["t1", "t2"], "left").select("doc_id", "text", "spans", "passages")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
