"""Cutting a plan where what follows reads it more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share.

    Where none is named, a local session (one machine, as in tests) gets a temporary one; a cluster gets an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lapwing-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def grown(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the other one: they are sorted and merged, whatever its size.

    A side of some 10 MB as shuffled is several hundred as a hash table, which the driver would have to hold and send.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
