"""tessera — topic discovery over document tables, written as Spark jobs."""

import sys as _sys

try:  # ship our own functions (pandas UDF bodies) by value when workers lack the package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
