"""logloom: a PySpark-native engine that turns raw system logs into structured events.

Python workers receive the package by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
