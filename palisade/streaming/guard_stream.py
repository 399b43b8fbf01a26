"""The guard over a stream of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palisade.operators.intent_model import IntentModel
from palisade.plans.guard import GuardConfig, guard
from palisade.sources.requests import REQUEST_FIELDS, with_request_defaults


def read_prompt_stream(
    spark: SparkSession, path: str, schema: str, glob: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def read_request_stream(spark: SparkSession, path: str, key: str = "", files_per_batch: int = 1000) -> DataFrame:
    """Request JSON files arriving in a folder, defaults filled in.

    Pass the result to :func:`palisade.plans.guard.guard_requests`, which is as
    stateless as :func:`guard_stream`.
    """
    fields = f"{key}, {REQUEST_FIELDS}" if key else REQUEST_FIELDS
    reader = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch)
    return with_request_defaults(reader.json(path))


def guard_stream(
    prompts: DataFrame,
    model: IntentModel,
    config: GuardConfig = GuardConfig(),
    text_col: str = "text",
    tool_context: str | None = None,
) -> DataFrame:
    """Scan, score, gate and assemble each arriving row.

    Every step is stateless, scoring included, so the stream runs in append mode
    without watermark or state store.  A model in join form needs
    :func:`start_batches`.
    """
    return guard(prompts, model, config, text_col, tool_context)


def start(guarded: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the guarded stream as parquet, exactly once per input row."""
    writer = guarded.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_batches(
    prompts: DataFrame,
    model: IntentModel,
    path: str,
    checkpoint: str,
    config: GuardConfig = GuardConfig(),
    text_col: str = "text",
    tool_context: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Guard a stream batch by batch, for models of any size.

    Scoring by join aggregates, which a stream could only do with state; inside
    of a batch it is an ordinary job.  A batch writes the folder
    ``batch_id=<number>`` of ``path`` and replaces whatever an earlier try left in
    it.  The stream's checkpoint gives a batch that is run again the same number
    and rows, so each row is in the result once, after any failure; readers of
    ``path`` get the number as a column.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        guarded = guard(batch, model, config, text_col, tool_context)
        guarded.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    writer = prompts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
