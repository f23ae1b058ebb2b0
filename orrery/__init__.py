"""Orrery: text, relational and similarity analytics declared on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value: the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
