"""Perceptual-quality analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
