"""A Spark-native engine for large collections of overlapping observations."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
