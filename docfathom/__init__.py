"""docfathom: document retrieval and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
