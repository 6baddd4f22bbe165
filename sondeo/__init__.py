"""Dataset-level analysis operators on Spark: profile, quality, exploration, sequences, segments, report."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
