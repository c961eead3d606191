"""Row-wise operators on a stream.

The source has no stateful stream operator; its row-wise operators (filters,
column functions) are stateless and run unchanged on a streaming DataFrame.
This module wires one such pipeline: new answer files in a folder are
cleaned, flagged and measured, and appended to a Parquet sink with a
checkpoint in the shared checkpoint folder (restartable after failures).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.text import token_length
from pairlab.operators.augment import drop_failed_completions
from pairlab.session import checkpoint_dir

ANSWER_SCHEMA = T.StructType([
    T.StructField("src_id", T.LongType()), T.StructField("gen_idx", T.IntegerType()),
    T.StructField("code", T.StringType())])


def score_answers(answers: DataFrame) -> DataFrame:
    """Stateless per-row scoring: failed flag (F14) and token length."""
    return drop_failed_completions(answers).withColumn(
        "n_tokens", F.when(F.col("failed"), F.lit(0)).otherwise(token_length(F.col("code"))))


def stream_answers(spark: SparkSession, source: str, sink: str, *, schema: T.StructType = ANSWER_SCHEMA,
                   name: str = "answers", fmt: str = "parquet", available_now: bool = True):
    """Start the streaming job: ``source`` folder -> ``score_answers`` -> ``sink``.

    Returns the StreamingQuery; with ``available_now`` it processes what is
    there and stops.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    out = score_answers(stream)
    writer = (out.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
