"""Semantic-ID analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow kernels live in this package. Shipping them by value lets executors run
# them without the package being installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
