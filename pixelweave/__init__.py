"""pixelweave: raster, point-cloud, mesh and lineage analytics on PySpark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions of this package travel inside the tasks that use them, so executors need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
