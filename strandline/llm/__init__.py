"""Training-data operators. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors receive this subpackage's functions by value, so that jobs also run
# where the repository is on the driver's path only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
