"""Demand-surge analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
