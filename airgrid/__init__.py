"""airgrid: Spark-native analytics for keyed hourly station time series.

Raw sensor readings and weather are cleaned, pivoted and laid on a gap-free
hourly grid per station; features, models, recursive forecasts, backtests,
explanations and recommendations are all DataFrame / SQL / Spark ML jobs
partitioned by the station key.
"""

import sys as _sys

try:  # ship the package's Python helpers (UDF bodies) by value to the workers
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile
    pass

from airgrid.session import get_spark, ensure_checkpoint_dir, scratch_path  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir", "scratch_path"]
