"""Structured Streaming forms: subscription with commits, deduplication, watermarks and acknowledgement joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import assign_seq


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path, with the schema they have now; rate-limited for back-pressure."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], commit: Callable[[DataFrame, int], None], checkpoint: str, topic: str | None = None, committed: DataFrame | None = None, redeliver: bool = False):
    """Delivers each micro-batch in (pid, epoch, seq) order to `handler`, then to `commit`: at least once.

    The batch number lets either side skip a batch that is delivered again after a failure. A restart with the same
    checkpoint goes on where it ended; a new one resumes behind the offsets in `committed` (topic, pid, epoch, seq: the
    last record that was taken), or at them, so that the last record comes again, with redeliver.
    """
    wanted = stream if topic is None else stream.where(F.col("topic") == topic)
    if committed is not None:
        at = committed.select("topic", "pid", F.struct("epoch", "seq").alias("_at"))
        wanted = wanted.join(at, ["topic", "pid"], "left").where(f"_at is null or struct(epoch, seq) {'>=' if redeliver else '>'} _at").drop("_at")

    def deliver(batch: DataFrame, number: int) -> None:
        ordered = batch.repartition("pid").sortWithinPartitions("pid", "epoch", "seq")
        handler(ordered, number)
        commit(ordered.groupBy("topic", "pid").agg(F.max(F.struct("epoch", "seq")).alias("at")), number)

    return wanted.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


#: How long a consumer waits between micro-batches, by the name of a waiting strategy.
TRIGGERS = {"busy": {"processingTime": "0 seconds"}, "adaptive": {"processingTime": "100 milliseconds"}, "blocking": {"processingTime": "1 second"}, "drain": {"availableNow": True}}


def ingest(stream: DataFrame, path: str, checkpoint: str, order: str = "arrival", wait: str = "drain"):
    """Appends a stream of messages (pid, epoch, order and others) to the log at path, with sequence numbers.

    A micro-batch's records follow the high watermark of each (pid, epoch) stored by those before it. Its folder bears
    its number and is written anew if it is delivered again, and numbers behind it are not looked at: exactly once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = assign_seq(batch, order)
        if number:
            before = high_watermark(spark.read.option("basePath", path).parquet(*[f"{path}/batch={k}" for k in range(number)])).drop("records")
            own = own.join(before, ["pid", "epoch"], "left").withColumn("seq", F.col("seq") + F.coalesce(F.col("hwm") + 1, F.lit(0))).drop("hwm")
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**TRIGGERS[wait]).start()


def dedup(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """First arrival of each key; with a time column and a delay, state is dropped behind the watermark."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def high_watermark(stream: DataFrame) -> DataFrame:
    """Running watermark of each (pid, epoch); for complete or update mode."""
    return stream.groupBy("pid", "epoch").agg(F.max("seq").alias("hwm"), F.count("*").alias("records"))


def acknowledgements(requests: DataFrame, acks: DataFrame, delay: str, within: str) -> DataFrame:
    """Stream-stream join of requests (correlation_id, sent) and acks (correlation_id, acked) within a time bound."""
    r = requests.withWatermark("sent", delay)
    a = acks.withColumnRenamed("correlation_id", "_id").withWatermark("acked", delay)
    return r.join(a, F.expr(f"correlation_id = _id and acked >= sent and acked <= sent + interval {within}")).drop("_id")


def drain(result: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming result over what its sources hold now and gives it as a table."""
    spark = result.sparkSession
    base = shared(spark, "stream")
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{base}/out")

    # a complete result replaces the one before: the last batch's table is the answer
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
