"""Kernel-based binary classification as Spark jobs over DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
