"""Operators of a training-data pipeline.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions for Spark tasks travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
