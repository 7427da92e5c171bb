"""Watchbill: duty-roster analytics expressed as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
