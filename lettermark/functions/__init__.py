"""Building blocks of the operators."""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
