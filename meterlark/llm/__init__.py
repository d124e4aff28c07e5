"""Operators for preparing training text. Nothing outside this folder imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need only numpy, pyarrow and the like, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
