"""lexforge: a PySpark-native engine for reusing passages of long, structured documents."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Worker functions travel by value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
