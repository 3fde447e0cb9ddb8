"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
