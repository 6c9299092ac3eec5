"""Tabulary: Spark operators for record linkage, hierarchical text, spatial lookup and ranked search."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions reach the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
