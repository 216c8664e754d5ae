"""Merkle fixity audit of archived web records.

A page is written as one WARC response record; the pages of FILE_PAGES successive ids form an archive file, in which
records lie in the order of their ids at offsets that a running sum gives. A record's hash is a leaf. The records that
start in RANGE_BYTES successive bytes of a file form an offset range, whose node hashes their offsets, ids and hashes in
order; a file's node hashes its ranges in order; FANOUT successive files form a node, and so on up to one root. Two
replicas are compared from the root: only the children of nodes that differ are looked at on the next level, down to the
records of differing ranges. Where a record's size changed, the ranges behind it in its file differ too, as offsets
moved; records that are the same there are told by their hashes and not reported.

Every level is one aggregation of bounded groups, so levels stay balanced whatever the hosts or sizes of the pages; both
replicas go through the same aggregation, so comparing needs no join.

Edge cases: null urls and bodies are empty; pages without an id are left out of trees (nothing names them); pages that
share an id are one leaf over the multiset of their records, told by their number, least, greatest and a sum of their
hashes, with the offset of the first; an empty replica differs in every leaf of the other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, stored

#: Powers of two: 256 pages a file, 64 KiB a range, 64 children a node.
FILE_BITS, RANGE_BITS, FANOUT_BITS = 8, 16, 6
FILE_PAGES, RANGE_BYTES, FANOUT = 1 << FILE_BITS, 1 << RANGE_BITS, 1 << FANOUT_BITS


def record(url: Column, html: Column) -> Column:
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """key, file, at (offset in the file), size, hash: one row per page id."""
    rec = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("key"), record(F.col("url").cast("string"), F.col("html").cast("string")).alias("r"))
    one = rec.select("key", F.octet_length("r").cast("long").alias("size"), F.sha2(F.encode("r", "UTF-8"), 256).alias("h"))
    # bounded state for ids that repeat; 60 bits of each hash are summed as decimals
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")
    leaf = one.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum(number).alias("s"))
    leaf = leaf.select("key", "size", F.when(F.col("n") == 1, F.col("lo")).otherwise(F.sha2(F.concat_ws(":", "n", "lo", "hi", "s"), 256)).alias("hash"))
    file = F.shiftright("key", FILE_BITS)  # rounds down, for ids below 0 and above 2**53 too
    before = Window.partitionBy("file").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("file", file).select("key", "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"), "size", "hash")


def _node(kids: Column, side: str) -> Column:
    """The hash of a node in one replica: of its children's names and hashes, in order; null where it has none."""
    own = F.filter(kids, lambda k: k[side].isNotNull())
    return F.when(F.size(own) > 0, F.sha2(F.array_join(F.transform(own, lambda k: F.concat_ws("=", k["name"], k[side])), ";"), 256))


def _level(below: DataFrame, *key: Column) -> DataFrame:
    """Nodes over the rows (..., name, ha, hb) of the level below, grouped by key."""
    grouped = below.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "ha", "hb"))).alias("kids"))
    return grouped.withColumns({"ha": _node(F.col("kids"), "ha"), "hb": _node(F.col("kids"), "hb")}).drop("kids")


@stored("damage")
def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """file_id, page_id, status (changed, missing, extra), at and size in either replica, of records that differ."""
    side = lambda x, k: leaves(x).withColumn("side", F.lit(k))
    base = materialize(side(one, "a").unionByName(side(two, "b")).withColumn("range", F.shiftright("at", RANGE_BITS)), "leaves")
    span = base.agg(F.min("file"), F.max("file")).first()
    # offsets are written with leading zeros, so that names sort as they do
    name = F.concat_ws(":", F.format_string("%020d", "at"), "key", "size")
    of = lambda k: F.when(F.col("side") == k, F.col("hash"))
    ranges = materialize(_level(base.select("file", "range", name.alias("name"), of("a").alias("ha"), of("b").alias("hb")), F.col("file"), F.col("range")), "ranges")
    files = _level(ranges.select("file", F.col("range").alias("name"), "ha", "hb"), F.col("file"))
    levels = [materialize(files.select((F.col("file") - F.lit(span[0])).alias("name"), "ha", "hb"), "nodes")]
    width = 0 if span[0] is None else span[1] - span[0]
    while width:  # up to one root, whatever the sign of the ids
        width >>= FANOUT_BITS
        levels.append(materialize(_level(levels[-1].withColumn("up", F.shiftright("name", FANOUT_BITS)), F.col("up")).withColumnRenamed("up", "name"), "nodes"))
    differ = ~F.col("ha").eqNullSafe(F.col("hb"))
    # descend: the nodes to look at on a level are the children of those that differ above
    above = levels[-1].where(differ).select(F.col("name").alias("up"))
    for nodes in reversed(levels[:-1]):
        looked = nodes.join(above, F.shiftright(nodes["name"], FANOUT_BITS) == F.col("up"), "left_semi")
        above = looked.where(differ).select(F.col("name").alias("up"))
    bad = above.select((F.col("up") + F.lit(span[0])).alias("file"))
    bad = ranges.join(bad, "file", "left_semi").where(differ).select("file", "range")
    seen = base.join(bad, ["file", "range"], "left_semi")
    rec = F.struct("at", "size", "hash")
    both = seen.groupBy("file", "key").agg(F.max(F.when(F.col("side") == "a", rec)).alias("a"), F.max(F.when(F.col("side") == "b", rec)).alias("b"))
    found = both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return found.select(F.col("file").alias("file_id"), F.col("key").alias("page_id"), status.alias("status"), F.col("a.at").alias("at_a"), F.col("a.size").alias("size_a"), F.col("b.at").alias("at_b"), F.col("b.size").alias("size_b"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults, for trials: one page in 97 altered, one in 211 lost, one in 331 added."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    changed = p.where("page_id is null or pmod(page_id, 211) <> 7").withColumn("html", F.when(F.expr("pmod(page_id, 97) = 13"), F.concat(F.lit("~"), F.coalesce("html", F.lit("")))).otherwise(F.col("html")))
    more = p.where("pmod(page_id, 331) = 5").select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return changed.unionByName(more)


SQL = r"""
with rec as (
  select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' as head, coalesce(html, '') as body from pages),
one as (select page_id, head || cast(octet_length(encode(body)) as varchar) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) as r from rec),
bad as (
  select page_id, head || cast(octet_length(encode(b)) as varchar) || chr(13) || chr(10) || chr(13) || chr(10) || b || chr(13) || chr(10) || chr(13) || chr(10) as r
  from (select page_id, head, case when page_id % 97 = 13 then '~' || body else body end as b from rec where page_id % 211 <> 7)
  union all select -page_id - 1, r from one where page_id % 331 = 5),
la as (select page_id, cast(floor(page_id / 256.0) as bigint) as f, octet_length(encode(r)) as size, sha256(r) as h from one),
lb as (select page_id, cast(floor(page_id / 256.0) as bigint) as f, octet_length(encode(r)) as size, sha256(r) as h from bad),
oa as (select *, cast(coalesce(sum(size) over (partition by f order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as at from la),
ob as (select *, cast(coalesce(sum(size) over (partition by f order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as at from lb)
select coalesce(a.f, b.f) as file_id, coalesce(a.page_id, b.page_id) as page_id,
  case when b.page_id is null then 'missing' when a.page_id is null then 'extra' else 'changed' end as status,
  a.at as at_a, a.size as size_a, b.at as at_b, b.size as size_b
from oa a full join ob b on a.page_id = b.page_id where a.h is distinct from b.h
"""
