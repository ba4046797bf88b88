"""Lodestone: a PySpark-native entity search and analytics engine."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
