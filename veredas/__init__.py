"""Spark-first analytics over synthetic tabular profiles."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
