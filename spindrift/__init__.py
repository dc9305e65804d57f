"""Spindrift: a PySpark-native engine for source code and text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
