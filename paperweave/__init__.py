"""paperweave: scholarly-graph analytics (search, citation and similarity
neighbourhoods, snapshot loading, embeddings) as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python functions of this package that run inside tasks (pandas UDFs, the
# block scorer, encoders) are pickled by value, so executors do not need the
# package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
