"""Operators for preparing training data; nothing outside this folder uses them.

``registry`` lists their queries, one per operator, over whole tables.
"""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel whole, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
