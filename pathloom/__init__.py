"""Path and resampling analytics on Spark DataFrames."""

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# functions used inside tasks travel with the job, so executors need no install
_by_value(_sys.modules[__name__])
