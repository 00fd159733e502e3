"""Spark-first analytics operators over lake files, tables, streams, text and vectors."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
