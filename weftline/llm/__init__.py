"""Operators for preparing training corpora; nothing else in the library imports this subpackage.

Functions sent to executors are pickled by value, so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
