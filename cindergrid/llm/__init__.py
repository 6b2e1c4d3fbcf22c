"""Operators for preparing training data at scale; nothing outside this package imports them."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so workers need no copy of this library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
