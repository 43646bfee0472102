"""The same rules over a stream: every micro-batch is one arriving batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.profile import Baseline
from tidegauge.operators.validate import OUTCOME, Rules, evaluate
from tidegauge.session import rows


def outcomes_of_batch(batch: DataFrame, batch_id: int, baseline: Baseline, rules: Rules = Rules()) -> DataFrame:
    return evaluate(batch, baseline, rules).withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def validate_stream(
    stream: DataFrame, baseline: Baseline | Callable[[], Baseline], sink: str, checkpoint: str, rules: Rules = Rules(), available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Write the outcomes of each micro-batch to ``sink``/batch_id=N.

    A replayed batch overwrites its own folder, so the result is the same however often Spark retries.
    ``baseline`` may be a function, asked once per batch, so a newly accepted baseline takes effect.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        current = baseline() if callable(baseline) else baseline
        # the rules read the batch several times; it is computed once
        held = batch.persist()
        try:
            outcomes_of_batch(held, batch_id, current, rules).drop("batch_id").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return trigger.start()


def stream_outcomes(spark, sink: str) -> DataFrame:
    schema = f"{OUTCOME}, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(sink)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return rows(spark, [], schema)
