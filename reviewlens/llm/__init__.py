"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
