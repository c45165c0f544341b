"""Panel time-series analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
