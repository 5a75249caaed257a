"""ordersight: distribution-operations analytics as Spark jobs.

Typed star-schema marts over Parquet, governed service / inventory / vendor
queries, policy-threshold rule operators, table data-quality checks and a
Markdown chunking + exact cosine search text side.  Every heavy step is a
DataFrame plan; Python runs only inside Arrow batches (chunker, embedder).
"""

import sys as _sys

# Functions shipped to Python workers (chunker, embedder, similarity) are
# pickled by value, so executors need neither this package installed nor the
# driver's working directory on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 -- older cloudpickle: fall back to by-reference pickling
    pass

from ordersight.session import build_session, checkpoint_dir  # noqa: E402,F401

__all__ = ["build_session", "checkpoint_dir"]
