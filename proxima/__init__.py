"""proxima: exact k-nearest-neighbour search and classification as Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The functions this package runs inside tasks (mapInArrow / applyInArrow kernels) are pickled
# by value, so executors need no copy of the package on their path (no --py-files step).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from proxima.plans.classify import knn_classify, knn_neighbors  # noqa: E402

__all__ = ["knn_classify", "knn_neighbors"]
