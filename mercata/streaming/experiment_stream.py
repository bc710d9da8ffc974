"""A/B arm readout as a streaming aggregation.

State is one row per (experiment, arm): users and clicks so far (the same
``arm_counts`` aggregation as the batch readout). Each micro-batch's complete
result has arms x experiments rows; ``arm_readout`` turns it into rates and
lift and lands in a folder of its own (``epoch=N``), so a reader always finds a
whole result and a repeated batch only replaces itself. The caller names the
checkpoint folder: a restart with the same one goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mercata.operators.experiment import arm_counts, arm_readout


def arm_counts_stream(events: DataFrame, arm: str = "dmp_id", outcome: str = "click",
                      experiment_id: str | None = None, positive=1) -> DataFrame:
    """Streaming (experiment, arm) -> n, clicks running totals."""
    return arm_counts(events, arm, outcome, experiment_id, positive)


def start_arm_summary(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str,
                      arm: str = "dmp_id", outcome: str = "click", control=1, experiment_id: str | None = None,
                      name: str = "arm_summary", available_now: bool = True) -> StreamingQuery:
    """Keep the newest epoch of ``sink_dir`` equal to ``arm_summary`` over all
    parquet event files that have arrived in ``source_dir``. ``checkpoint_dir``
    must be a folder that outlives the driver (shared, on a cluster)."""
    events = spark.readStream.schema(schema).parquet(source_dir)
    counts = arm_counts_stream(events, arm, outcome, experiment_id)

    def publish(batch: DataFrame, epoch: int) -> None:
        arm_readout(batch, arm, control, experiment_id).write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")

    writer = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir)
              .foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.queryName(name).start()


def latest_arm_summary(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest result in ``sink_dir``."""
    out = spark.read.parquet(sink_dir)
    return out.filter(F.col("epoch") == out.agg(F.max("epoch")).scalar()).drop("epoch")
