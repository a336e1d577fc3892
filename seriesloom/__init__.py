"""Panel and time-series operators for PySpark.

Every public operator takes DataFrames and returns a DataFrame. The package is
pickled by value, so Python workers on a cluster need no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
