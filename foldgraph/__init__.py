"""RNA secondary-structure graphs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from foldgraph.errors import GraphError, RecordError, SpecMismatch
from foldgraph.spec import EncoderShape, GraphSpec

__all__ = ["EncoderShape", "GraphError", "GraphSpec", "RecordError", "SpecMismatch"]

# The few functions that run in Python workers travel with their tasks, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
