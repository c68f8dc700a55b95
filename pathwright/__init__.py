"""Citation-pathway analytics on Spark: DataFrame operators, sources, functions and plans."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
