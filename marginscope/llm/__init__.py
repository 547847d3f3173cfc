"""Operators for preparing training data, each one a function of DataFrames.

Python that runs in tasks is shipped with the job (pickled by value), so the
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
