"""merchlake: product-listing analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the tasks, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
