"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks get the kernels of this package with their closures, so executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])
