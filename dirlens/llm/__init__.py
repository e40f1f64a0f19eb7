"""Operators of a training-data pipeline over text and embedding tables; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the plan, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
