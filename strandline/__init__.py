"""A Spark engine for time-coded, speaker-labelled text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors receive the package's functions by value, so that jobs also run where it is on the driver's path only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
