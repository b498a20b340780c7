"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Its functions run in Python workers, so they are
pickled by value: a cluster needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
