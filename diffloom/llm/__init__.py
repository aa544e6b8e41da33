"""Operators of a training-data pipeline: deduplication, language, decontamination, privacy, toxicity, packing, search."""

import sys

from pyspark import cloudpickle

# Python tasks carry their functions with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
