"""Spreading the work on a few large files over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

_BEYOND_A_SCAN = ("Aggregate", "Join", "Window", "Exchange", "Sort", "Union", "MapIn", "Limit", "Generate", "Python")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores, if it is a plain scan of fewer; else as it is.

    Table formats split at row groups, so that a small table in one file would be read, and then worked on, by a single
    task. A scan of many files isn't touched: large tables are never shuffled for this."""
    if df.isStreaming:
        return df
    execution = df._jdf.queryExecution()
    plan = execution.sparkPlan().toString()
    if any(word in plan for word in _BEYOND_A_SCAN):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
