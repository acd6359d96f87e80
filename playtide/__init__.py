"""Listening-history analytics and training-data operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
