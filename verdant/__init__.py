"""Field-monitoring analytics expressed as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so workers need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
