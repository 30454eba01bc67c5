"""Spark-native tables and columns for the data work around model tuning."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
