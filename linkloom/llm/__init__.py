"""Operators for preparing training text at scale.

Functions defined here travel by value inside Spark jobs, so executors need no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
