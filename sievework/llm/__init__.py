"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
