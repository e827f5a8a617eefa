"""embedlens: health analytics for embedding collections, as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from embedlens.sources.collections import Collection

# task functions travel to executors whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Collection"]
