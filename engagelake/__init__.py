"""Spark-native analytics for social-engagement data: Bronze, Silver and Gold tables, reports and models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
