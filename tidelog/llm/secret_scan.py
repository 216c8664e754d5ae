"""Secret scanning over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger has a row for each (blob, rule, rule
version) that has been scanned, with its findings; only pairs that it lacks are scanned, each blob once however many
paths and versions carry it, and findings are joined back to all of them. A changed rule rescans for that rule alone.

Rules are regular expressions with a group whose length decides. A match's position is the running sum of the lengths
of the pieces around matches (split) and of the matches themselves, in code points; matches are rows there, so that a
text with very many of them costs no more than its share. Matches are leftmost and do not overlap within a rule; those
that are too short are dropped after matching.

Edge cases: a null text is the empty blob, without findings; null or repeated paths keep one row per row of the input;
rows of the ledger that repeat count once; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    #: a cheap test that every match passes
    hint: str | None = None
    revision: int = 1

    @property
    def version(self) -> str:
        """Changes with all that decides what the rule finds."""
        return f"{self.revision}:{self.group}:{self.least}:{self.pattern}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones never hide part of a longer one
)
SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def steps(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<kind, gap, size, n>>: for each match the length of what lies before it, its own and its group's."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    # a match alone is matched again just as within the text: no rule looks around
    size = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    found = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), whole, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), size(m).alias("n")))
    maybe = F.contains(text, F.lit(rule.hint)) if rule.hint else F.rlike(text, F.lit(rule.pattern))
    return F.when(maybe, found).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,n:int>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind (a rule's place), found: the spans of those rules that find any; blobs has (blob, text, lacks)."""
    todo = [F.when(F.array_contains("lacks", k), steps(F.col("text"), r, k)).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,n:int>>")) for k, r in enumerate(rules)]
    rows = blobs.select("blob", F.posexplode(F.concat(*todo)).alias("pos", "m")).select("blob", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind").orderBy("pos"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    placed = rows.withColumn("end", end).where(F.col("n") >= least).select("blob", "kind", F.struct((F.col("end") - F.col("size")).alias("start"), "end", "kind").alias("span"))
    return placed.groupBy("blob", "kind").agg(F.array_sort(F.collect_list("span")).cast(SPANS).alias("found"))  # of one text


def scan(named: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger lacks of (blob, text) rows.

    Gives (blob, found) of blobs with findings, and the ledger rows (blob, kind, version, found) to append.
    """
    kinds = F.array(*[F.lit(k) for k in range(len(rules))])
    # equal contents meet on the map side before they travel
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    known = None
    if ledger is None:
        blobs = blobs.withColumn("lacks", kinds)
    else:
        now = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", k)])
        known = ledger.withColumn("kind", F.try_element_at(now, F.concat_ws(":", "kind", "version"))).where("kind is not null").select("blob", "kind", "found").dropDuplicates(["blob", "kind"])
        has = known.groupBy("blob").agg(F.collect_set("kind").alias("has"))
        blobs = blobs.join(has, "blob", "left").withColumn("lacks", F.array_except(kinds, F.coalesce("has", F.array().cast("array<int>")))).where(F.size("lacks") > 0).drop("has")
    fresh = materialize(scan_blobs(blobs, rules), "findings")
    scanned = blobs.select("blob", F.explode("lacks").alias("kind")).join(fresh, ["blob", "kind"], "left")
    name, version = (F.element_at(F.array(*[F.lit(x) for x in values]), F.col("kind") + 1) for values in ([r.kind for r in rules], [r.version for r in rules]))
    new = scanned.select("blob", name.alias("kind"), version.alias("version"), F.coalesce("found", F.array().cast(SPANS)).alias("found"))
    every = fresh if known is None else fresh.unionByName(known.where(F.size("found") > 0))
    # a ledger's findings carry the place that the rule had then
    every = every.select("blob", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.col("kind").alias("kind"))).alias("found"))
    # stored, so that a join with a blob that very many paths have can be split
    return materialize(every.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")), "found"), new


def address(versions: DataFrame) -> DataFrame:
    """path, text, blob of (path, text) rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.select("path", text.alias("text")).withColumn("blob", blob_id(F.col("text")))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan (path, text) rows, any number of versions a path.

    Gives (path, blob, found) for every row, and the ledger rows to append. Only (blob, rule, version) that `ledger`
    lacks are scanned.
    """
    named = address(versions)
    found, new = scan(named.select("blob", "text"), ledger, rules)
    out = named.select("path", "blob").join(found, "blob", "left")
    return out.select("path", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found")), new


def scan_increments(increments: list[DataFrame], rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans one increment of versions after the other, each against the stored ledger of those before it.

    Gives (path, blob, found) for every row of all increments, and the whole ledger.
    """
    ledger, out = None, None
    for versions in increments:
        found, new = scan_versions(versions, ledger, rules)
        new = materialize(new, "ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
        out = found if out is None else out.unionByName(found)
    return out, ledger


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of every rule, base_sha256 and spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(F.encode(text, "UTF-8"), 256).alias("base_sha256"), text.alias("spans"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] >= acc["at"], F.concat(acc["text"], F.substring(text, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["text"]).alias("text"))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda a: F.concat(a["text"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))).otherwise(text)
