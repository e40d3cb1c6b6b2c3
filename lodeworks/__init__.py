"""lodeworks: a Spark-first engine for moving, reshaping and querying tables.

The functions that run inside executors are shipped by value, so a cluster
needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
