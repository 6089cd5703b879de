"""churnlens: customer-retention analytics as Spark DataFrame jobs.

Every operator takes and returns a lazy ``DataFrame`` keyed by ``customerID``;
fitted state is a small value object or a small table, never a row buffer on
the driver.
"""

__version__ = "0.1.0"

# Functions shipped to Python workers (mapInPandas, applyInPandas) are pickled by
# value, so executors need no copy of this package on their path.
import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass
