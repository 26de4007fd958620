"""Shortest paths over obstacle grids, and the run analytics around them, as Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel whole, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
