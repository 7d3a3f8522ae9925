"""feedloom: preparing, evaluating and analysing training-input data with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so a cluster needs no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
