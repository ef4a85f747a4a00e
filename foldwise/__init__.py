"""Foldwise: leak-safe evaluation of regression models on large keyed tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

from .errors import ContractViolation, LabelAccessError

# Functions that run in Python workers travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ContractViolation", "LabelAccessError"]
