"""Causal analysis of large tables, written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# helpers used inside tasks travel with the task, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
