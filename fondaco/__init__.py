"""fondaco: a Spark-first engine for text knowledge bases."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions sent to executors travel by value, so executors need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
