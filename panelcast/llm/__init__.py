"""Operators for preparing large training corpora.

Each module holds one operator; ``queries`` registers one thin query per
operator over the provided tables. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that a session
# works whether or not its executors have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
