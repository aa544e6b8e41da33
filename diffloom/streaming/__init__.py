"""Structured Streaming over review activity and moving snapshots."""

import sys

from pyspark import cloudpickle

# State processors travel to the Python workers by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
