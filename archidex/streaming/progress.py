"""Progress counters of a running ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(entries: DataFrame, observation: Observation) -> DataFrame:
    """``entries`` that report files, directories, bytes and errors as they are written.

    The counters ride on the job that writes the entries, at no extra pass.
    They are complete once the action has finished.
    """
    is_file = F.col("kind") == "file"
    failed = F.col("error").isNotNull() if "error" in entries.columns else F.lit(False)
    return entries.observe(
        observation,
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(failed).alias("errors"),
    )
