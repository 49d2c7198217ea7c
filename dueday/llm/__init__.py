"""Operators for training-data pipelines. Nothing else in the library imports this.

Tasks get the functions of this subpackage by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
