"""Weftline: keyed data integration and corpus preparation on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions of this package travel to executors whole: the package need not be installed there
register_pickle_by_value(sys.modules[__name__])
