"""Security knowledge and evidence analytics as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few helpers that run in Python workers travel with their task, so executors
# need no copy of this package and jobs may start from any folder.
register_pickle_by_value(sys.modules[__name__])
