"""Trajectory analytics and text-data operations on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the tasks, so no copy of it has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
