"""Analytics over document and conversation corpora, as declarative DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with their tasks, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
