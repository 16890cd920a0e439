"""Operators for training data at scale. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with the job, so that executors need no copy of them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
