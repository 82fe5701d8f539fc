"""jsonmill: a PySpark-native engine for JSON documents held in columns or files.

Nothing heavy happens on import.  Functions that run inside Python workers are
shipped by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
