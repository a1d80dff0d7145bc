"""Work dealt over tasks by what becomes of a row, not by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as ``spark.sql.shuffle.partitions`` says.

    A compact file is read by few tasks, and grouping there what hardly repeats holds all
    of its groups in one of them. Dealt out first, each task groups its own share.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, dealt by all of their columns before they are compared.

    For rows that hardly repeat: compared first in the few tasks that make them, as
    ``DataFrame.distinct`` does, nearly all of them would be held there.
    """
    return df.repartition(*df.columns).distinct()
