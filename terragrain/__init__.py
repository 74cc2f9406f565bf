"""terragrain: point clouds to rasters on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
