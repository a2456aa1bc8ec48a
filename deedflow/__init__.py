"""deedflow: registry-transaction analytics written as PySpark DataFrame functions."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to executors by value, so that they run where the package is not installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
