"""Operators for preparing training text, apart from the code analysis."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
