"""Small helpers shared by the operators: tables, the shared folder, written cuts of a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.session import checkpoint_dir

#: a word, as a Java regular expression: ASCII white space splits, nothing else
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only (locale free; other letters stay)."""
    return F.translate(c, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all machines share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/pairlab/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage with files that outlive any executor; what follows reads
    the same rows however often it is planned or recomputed.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
