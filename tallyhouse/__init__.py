"""Product-catalogue and warehouse-inventory analytics written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so jobs run from any folder and nothing must be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
