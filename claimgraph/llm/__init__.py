"""Training-data operators; nothing else in the library imports this package.

Functions of this package are sent to Python workers by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
