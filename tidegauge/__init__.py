"""Observation-quality operators for PySpark batch and streaming DataFrames."""

import sys

from pyspark import cloudpickle

from tidegauge.schema import Compat, WireNames

# Functions of this package travel to the executors with the tasks that use
# them, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Compat", "WireNames"]
