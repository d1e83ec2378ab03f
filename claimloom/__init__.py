"""claimloom: a Spark-native engine for evidence graphs built from text-derived mentions."""

from pyspark import cloudpickle

import claimloom

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(claimloom)

__version__ = "0.1.0"
