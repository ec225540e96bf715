"""Tessella: a PySpark-native engine for tiled images and the statistics of factorial experiments."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value, so the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
