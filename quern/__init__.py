"""quern: a Spark-native engine for searching and understanding a corpus of saved documents."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
