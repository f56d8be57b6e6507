"""Spark-native analytics over bibliographic data: cleaning, registries, pairs, graph and text features, models, metrics."""

import sys

from pyspark import cloudpickle

# What runs on executors travels with its task, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
