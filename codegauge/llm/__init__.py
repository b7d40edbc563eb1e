"""Operators for large training-text collections.

The package travels to the executors by value, so a worker needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
