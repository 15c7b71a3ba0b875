"""Spark-native analytics over asset inventories, software exposure and training corpora."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the plan, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
