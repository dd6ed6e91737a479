"""Tessera: a Spark-native engine for conversational training corpora and the tables around them."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
