"""Operators for preparing training text at scale; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so a worker's path need not hold the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
