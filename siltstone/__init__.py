"""Spark-native corpus search, retrieval and analytics operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
