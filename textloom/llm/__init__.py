"""Operators for building language-model training corpora; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
