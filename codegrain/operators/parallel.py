"""Keeping all cores busy when an input has fewer partitions than the session has cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores if its scan has fewer partitions, or files, than there are cores.

    A file of one row group is read by one task, however many splits are planned for it.

    For work that costs far more than moving its rows, such as inference.  Inputs of any size beyond a
    few splits are read in enough partitions and pass unchanged, without a shuffle.  Streams pass unchanged.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    few = parts < cores or (parts <= 4 * cores and 0 < len(df.inputFiles()) < cores)
    return df.repartition(cores) if few else df
