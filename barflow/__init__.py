"""Market-bar analytics as Spark DataFrame plans: bars, features, labels, regimes, gates, ledgers."""
import sys

from pyspark import cloudpickle

# Kernels that run inside tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
