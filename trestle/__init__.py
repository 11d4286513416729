"""Trestle: structural rules and corpus preparation as Spark plans.

Functions shipped to Python workers are pickled by value, so executors need
no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
