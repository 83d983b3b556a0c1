"""folioflow: Spark-first extraction, search, text and knowledge operators for document collections."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need not have this package: functions sent to Python workers travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
