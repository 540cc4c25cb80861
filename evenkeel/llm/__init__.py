"""Training-data operators over documents and pages; nothing outside this package imports it.

Functions of this package that run in Python workers are shipped by value, so that executors need
no copy of the repository.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
