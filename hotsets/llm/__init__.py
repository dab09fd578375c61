"""Operators for building training corpora: near duplicates, cleaning, scoring, packing, formatting.

Nothing else in the library imports this subpackage; the folder can be removed as a whole.
Its functions travel to the executors by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
