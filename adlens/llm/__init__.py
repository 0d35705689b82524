"""Operators for preparing language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Worker code travels with the task: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
