"""facetide: face-emotion event analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors themselves, which then need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
