"""Bitext analytics on Spark: build, check, score and catalogue parallel corpora with DataFrame programs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the functions by value, so the package needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
