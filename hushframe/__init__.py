"""Privacy-preserving table analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so only the driver needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
