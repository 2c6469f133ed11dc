"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# executors need not have this package installed: functions that run there travel with their task
cloudpickle.register_pickle_by_value(sys.modules[__name__])
