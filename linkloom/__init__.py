"""Internal-link analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster does not need the
# package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
