"""shopcast — behaviour-log feature and purchase-propensity engine on Spark.

Everything relational is a DataFrame plan over built-in expressions:

* ``sources``   — action-log / user / product / comment readers, driver-table
                  adapters, CSV / Parquet sinks.
* ``functions`` — scalar column helpers (time bins, ratios, one-hot, recodes).
* ``operators`` — the activity cube and the feature families computed from it
                  (counts, ratios, active days, recency, statistics, shares,
                  pivots), joins, top-k, sampling, models, metrics.
* ``plans``     — dataset builders that fuse families into one aggregate per
                  grain and join the grains to a base table.
* ``streaming`` — the same cube maintained incrementally from a file stream.
"""

from shopcast.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
