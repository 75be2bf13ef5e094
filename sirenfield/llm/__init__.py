"""Operators of a training-data pipeline; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

from .queries import ORACLE, QUERIES

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLE", "QUERIES"]
