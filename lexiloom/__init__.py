"""Spark-native encoding of dirty, high-cardinality string columns."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
