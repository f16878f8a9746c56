"""tablecheck: data-quality rules, profiling, cleaning and anomaly scoring as Spark jobs."""

import sys

from pyspark import cloudpickle

from tablecheck.functions.rules import Rule

# Functions that run in Python workers travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Rule"]
