"""Consumer offsets: last write wins by commit order; absent offsets are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["topic", "grp", "pid"]


def committed(commits: DataFrame) -> DataFrame:
    """topic, grp, pid, off: the offset of the last commit, even where it goes back."""
    return commits.groupBy(*KEY).agg(F.max_by("off", "commit_order").alias("off"))


def last_taken(commits: DataFrame) -> DataFrame:
    """topic, pid, epoch, seq: the newest record that a subscriber committed."""
    return commits.groupBy("topic", "pid").agg(F.max(F.struct("epoch", "seq")).alias("at")).select("topic", "pid", "at.*")


def committed_or_zero(wanted: DataFrame, commits: DataFrame) -> DataFrame:
    return wanted.select(*KEY).join(committed(commits), KEY, "left").select(*KEY, F.coalesce("off", F.lit(0)).cast("long").alias("off"))


def lag(watermarks: DataFrame, offsets: DataFrame) -> DataFrame:
    """pid, grp, hwm, off, lag: watermarks (pid, hwm) of every group in offsets (pid, grp, off), 0 where it never committed."""
    groups = offsets.select("grp").distinct()
    every = watermarks.crossJoin(groups)  # partitions by consumer groups: both catalogues, each pair a row of the result
    joined = every.join(offsets, ["pid", "grp"], "left").withColumn("off", F.coalesce("off", F.lit(0)).cast("long"))
    return joined.select("pid", "grp", "hwm", "off", (F.col("hwm") + 1 - F.col("off")).alias("lag"))


def replay_count(commits: DataFrame) -> DataFrame:
    return commits.groupBy("topic", "grp").agg(F.count("*").alias("replayed"), F.countDistinct("pid").alias("partitions"))
