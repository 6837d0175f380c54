"""Language time series on Spark: texts -> token series -> features -> selection -> stacking."""

import sys

from pyspark import cloudpickle

# Executors get the package's Arrow functions with the job, installed or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
