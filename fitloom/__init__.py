"""Evidence matching and training-data preparation on Spark.

The package is pickled by value, so that tasks run on executors where it is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
