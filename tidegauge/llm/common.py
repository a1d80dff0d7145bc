"""What the operators of this package share: reading, cutting lineage, worker state, query registration."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of a batch that Python gets; with texts of a few kB a batch has some MB.
BATCH_ROWS = 1000

#: Words of a text are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir) and, where SQL can say it, its DuckDB text."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only where that is unset, as
    in tests on one machine, a temporary one is made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows, for columns of long texts.

    The limit is a setting of the session, which is lowered where it is higher.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that one Python worker makes once and keeps for all tasks that it runs."""
    module = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document: crc32 of the id's decimal text. Fold 0 is held out, also for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
