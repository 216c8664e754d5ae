"""Stupid-backoff language-model scores from corpus-wide n-gram count tables partitioned by hash.

Every document is scored against all others: its own counts are taken off, or no n-gram would ever be unseen. With
counts f without the document's own, N words in all, and n-grams of up to `order` words,

    S(w | u v) = f(u v w) / f(u v)              where f(u v w) > 0
               = 0.4 * S(w | v)                 otherwise, and so on down to
    S(w)       = max(f(w), 1/2) / N;

a document's first words have shorter histories, without a factor.

Four steps: (1) documents become blocks: word numbers and the block's vocabulary of word hashes; (2) every block
explodes its n-grams and sends each distinct 64-bit hash with its local count to the hash's bucket; (3) a bucket adds up
its part of the count table, joins it to the n-grams it was sent and returns the counts in the order they came; (4) the
block joins them to its n-grams and sums per document. Frequent n-grams are aggregated before the shuffle and buckets
are hash ranges, so no key is hot; the returned counts are small numbers that compress well. Rows that cross the network
hold many n-grams: with one row for an n-gram of a document the shuffles alone would be some ten times the input.

A block meets its counts by its name, the task's number and its place therein. A task that is run again makes the same
blocks, as it reads files: an input that is itself shuffled is stored first.

Edge cases: null and empty texts have no words, score 0 and hits 0; repeated rows are documents of their own, so they
see each other; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import lean, materialize, slices, small_batches, stable, stored

BACKOFF = 0.4
ORDER = 3
#: Text bytes of a block, and of the texts whose n-grams a bucket holds.
BLOCK_BYTES = 1 << 23
BUCKET_BYTES = 1 << 23

U = np.uint64


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(name, ids, words of each document, word hashes) of runs of documents of about BLOCK_BYTES."""
    ids, lens, words, size = [], [], [], 0
    part, made = TaskContext.get().partitionId(), 0

    def block():
        nonlocal made
        made += 1
        return f"{part}-{made}", pa.concat_arrays(ids), np.concatenate(lens), np.concatenate(words)

    for b in batches:
        for at, data, offs in slices(b.column(1)):
            w, _, _, first = tk.words(data, offs)
            ids.append(b.column(0).slice(at, len(offs) - 1)), lens.append(np.diff(first)), words.append(w)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield block()
                ids, lens, words, size = [], [], [], 0
    if ids:
        yield block()


def _grams(w: np.ndarray, doc: np.ndarray, k: int):
    """n-grams of k words within documents: (first words, distinct hashes in order, place of each therein, counts)."""
    if k == 1:
        return np.arange(len(w)), *np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1]) if len(doc) >= k else np.zeros(0, np.int64)
    return at, *np.unique(tk.ngram_hash(w, k)[at], return_inverse=True, return_counts=True)


def _wire(x: np.ndarray) -> bytes:
    """Counts, nearly all small, a byte plane after the other."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unwire(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences; the high bytes, nearly all zero, are compressed, the low five kept as they are."""
    planes = np.diff(h, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(h).to_bytes(4, "little") + planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.empty((8, n), np.uint8)
    planes[:5] = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(5, n)
    planes[5:] = np.frombuffer(zlib.decompress(raw[4 + 5 * n :]), np.uint8).reshape(3, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U), dtype=U)


def _pack_words(w: np.ndarray) -> tuple[bytes, bytes]:
    """A block's vocabulary and its words as numbers therein, a byte plane after the other."""
    if not len(w):
        return b"", b""
    vocab, at = np.unique(w, return_inverse=True)
    planes = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _pack(vocab), zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack_words(vocab: bytes, numbers: bytes) -> np.ndarray:
    if not numbers:
        return np.zeros(0, U)
    planes = np.frombuffer(zstandard.decompress(numbers), np.uint8).reshape(4, -1)
    return _unpack(vocab)[np.ascontiguousarray(planes.T).view("<u4").ravel()]


def _own(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every occurrence (n-gram at, document doc) how often its document has the n-gram."""
    if not len(at):
        return at
    key = at.astype(np.int64) * (int(doc.max()) + 1) + doc
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back]


def _score(lens: np.ndarray, w: np.ndarray, counts: list[np.ndarray]):
    """Per document of a block: words, words by longer n-grams, by the longest, by single words, and the sum of ln S.

    counts[k - 1] has the corpus counts of the block's distinct n-grams of k words, in order of their hashes. The sum
    lacks the total's part, which every word scored alone has.
    """
    m = len(lens)
    doc = np.repeat(np.arange(m), lens)
    place = np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)
    level = np.ones(len(w), np.int64)
    longest = np.minimum(place + 1, len(counts))
    part = before = np.zeros(0)
    for k, f in enumerate(counts, 1):
        at, _, back, _ = _grams(w, doc, k)
        others = f[back].astype(np.int64) - _own(back, doc[at])
        end = at + k - 1
        now = np.zeros(len(w))
        now[end] = others
        if k == 1:
            part = np.log(np.maximum(now, 0.5))
        else:
            hit = end[others > 0]
            level[hit] = k
            part[hit] = np.log(now[hit]) - np.log(before[hit - 1])
        before = now
    part += np.log(BACKOFF) * (longest - level)
    total = lambda x: np.bincount(doc, weights=x, minlength=m).astype(np.float64)
    ints = [total(x).astype(np.int64) for x in (level > 1, level == len(counts), level == 1)]
    return lens.astype(np.int64), *ints, total(part)


@stored("scores")
def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_hits (words scored by an n-gram of two or more), n_full (of `order`), log_score, mean_log.

    log_score is the sum of ln S over a document's words, mean_log its mean.
    """
    small_batches(docs.sparkSession)
    src = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    edges = np.array([k * 2**64 // buckets for k in range(buckets)], U)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, lens, w in _blocks(batches):
            doc = np.repeat(np.arange(len(lens)), lens)
            for k in range(1, order + 1):
                _, h, _, n = _grams(w, doc, k)
                # buckets are ranges of the hash, so a sorted array is cut, not scattered
                cut = np.append(np.searchsorted(h, edges), len(h))
                for j in np.flatnonzero(np.diff(cut)).tolist():
                    a, e = cut[j], cut[j + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([(k - 1) * buckets + j], pa.int32()), pa.array([name]), pa.array([_pack(h[a:e])], pa.binary()), pa.array([_wire(n[a:e])], pa.binary())], ["bucket", "block", "grams", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(bucket, rows):
            grams = [_unpack(g) for _, g, _ in rows]
            every, at = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.concatenate([_unwire(c) for _, _, c in rows])
            f = np.bincount(at, weights=n, minlength=len(every))[at]
            ends = np.cumsum([0, *map(len, grams)])
            counts = [_wire(f[a:e]) for a, e in zip(ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([bucket] * len(rows), pa.int32()), pa.array(counts, pa.binary())], ["block", "bucket", "counts"])

        now, rows = None, []
        for b in batches:
            for r in range(b.num_rows):
                k = b.column(0)[r].as_py()
                if k != now and rows:
                    yield answer(now, rows)
                    rows = []
                now = k
                rows.append(tuple(b.column(c)[r].as_py() for c in range(1, 4)))
        if rows:
            yield answer(now, rows)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, lens, w in _blocks(batches):
            vocab, numbers = _pack_words(w)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([vocab], pa.binary()), pa.array([numbers], pa.binary())], ["block", "ids", "lens", "vocab", "words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, lens, vocab, words, got = (b.column(c)[r] for c in range(5))
                counts: list[list] = [[] for _ in range(order)]
                for g in got.as_py() or ():  # in the order of buckets, which is that of the sorted hashes
                    counts[g["bucket"] // buckets].append(_unwire(g["counts"]))
                full = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in counts]
                cols = _score(lens.values.to_numpy(), _unpack_words(vocab.as_py(), words.as_py()), full)
                yield pa.RecordBatch.from_arrays([ids.values, *[pa.array(c) for c in cols]], ["doc_id", "n_words", "n_hits", "n_full", "n_single", "part"])

    sent = src.mapInArrow(lean(send), "bucket int, block string, grams binary, counts binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(order * buckets, 20_000))
    back = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(lean(count), "block string, bucket int, counts binary")
    # one row for each block: its counts by bucket, bounded by the block's size
    own = back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("got"))
    kept = src.mapInArrow(lean(numbered), "block string, ids array<long>, lens array<long>, vocab binary, words binary")
    joined = kept.join(own, "block", "left").select("ids", "lens", "vocab", "words", "got")
    per = materialize(joined.mapInArrow(lean(judge), "doc_id long, n_words long, n_hits long, n_full long, n_single long, part double"), "sums")
    n = per.agg(F.sum("n_words")).first()[0] or 0
    rest = F.log(F.greatest(F.lit(n) - F.col("n_words"), F.lit(1)).cast("double"))
    log = F.col("part") - F.col("n_single") * rest
    return per.select("doc_id", "n_words", "n_hits", "n_full", F.round(log, 4).alias("log_score"), F.round(F.when(F.col("n_words") > 0, log / F.col("n_words")), 4).alias("mean_log"))


#: The same scores in SQL, for tables that fit one machine.
SQL = r"""
with ws as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as ws from documents),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from ws),
tri as (select doc_id, i, w, lag(w) over d as v, lag(w, 2) over d as u from words window d as (partition by doc_id order by i)),
total as (select count(*) as n from words),
f1 as (select w, count(*) as f from tri group by w),
f2 as (select v, w, count(*) as f from tri where v is not null group by v, w),
f3 as (select u, v, w, count(*) as f from tri where u is not null group by u, v, w),
d1 as (select doc_id, w, count(*) as f from tri group by doc_id, w),
d2 as (select doc_id, v, w, count(*) as f from tri where v is not null group by doc_id, v, w),
d3 as (select doc_id, u, v, w, count(*) as f from tri where u is not null group by doc_id, u, v, w),
own as (select doc_id, count(*) as n from words group by doc_id),
g as (
  select t.doc_id, case when t.u is not null then 3 when t.v is not null then 2 else 1 end as top,
    a1.f - b1.f as w1, av.f - bv.f as v1, a2.f - b2.f as w2, ap.f - bp.f as p2, a3.f - b3.f as w3, greatest(total.n - o.n, 1) as n
  from tri t join own o on o.doc_id = t.doc_id cross join total
  join f1 a1 on a1.w = t.w join d1 b1 on b1.w = t.w and b1.doc_id = t.doc_id
  left join f1 av on av.w = t.v left join d1 bv on bv.w = t.v and bv.doc_id = t.doc_id
  left join f2 a2 on a2.v = t.v and a2.w = t.w left join d2 b2 on b2.v = t.v and b2.w = t.w and b2.doc_id = t.doc_id
  left join f2 ap on ap.v = t.u and ap.w = t.v left join d2 bp on bp.v = t.u and bp.w = t.v and bp.doc_id = t.doc_id
  left join f3 a3 on a3.u = t.u and a3.v = t.v and a3.w = t.w left join d3 b3 on b3.u = t.u and b3.v = t.v and b3.w = t.w and b3.doc_id = t.doc_id),
scored as (
  select doc_id, case when w3 > 0 then 3 when w2 > 0 then 2 else 1 end as level,
    case when w3 > 0 then ln(w3) - ln(p2) when w2 > 0 then ln(w2) - ln(v1) else ln(case when w1 > 0 then w1 else 0.5 end) - ln(n) end
      + ln(0.4) * (top - case when w3 > 0 then 3 when w2 > 0 then 2 else 1 end) as s from g)
select d.doc_id, coalesce(x.n, 0) as n_words, coalesce(x.h, 0) as n_hits, coalesce(x.t, 0) as n_full, round(coalesce(x.s, 0), 4) as log_score, round(x.s / x.n, 4) as mean_log
from documents d left join (select doc_id, count(*) as n, cast(sum(case when level > 1 then 1 else 0 end) as bigint) as h, cast(sum(case when level = 3 then 1 else 0 end) as bigint) as t, sum(s) as s from scored group by doc_id) x on x.doc_id = d.doc_id
"""
