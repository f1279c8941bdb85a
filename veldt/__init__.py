"""veldt: recommendation analytics and training-data preparation on Spark DataFrames."""

import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark import cloudpickle  # noqa: E402

# Functions of this package travel to the executors by value: a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
