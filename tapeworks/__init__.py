"""Tapeworks: market research analytics over time-ordered tables, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so these need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
