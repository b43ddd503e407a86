"""vigil — security-log analytics on Spark.

Every operator takes DataFrames and returns DataFrames; the heavy lifting is
declared with the DataFrame / SQL API so Catalyst can prune, push down and
pick join strategies.  Sub-packages:

- ``vigil.sources``   typed batch readers, fixture view, sinks
- ``vigil.functions`` column expressions (scores, flags, text)
- ``vigil.operators`` hunting, behaviour baselines, investigation, alerts,
                      reports, metrics, models, explanations, forecast
- ``vigil.plans``     reusable plan shapes (chunked ordered scans) and the
                      catalogue of registered queries
- ``vigil.streaming`` Structured Streaming twins of the live stages
"""

import sys as _sys

# Executors run our Arrow-batched Python (keyed stream state, SHAP cells, LIME
# solve).  Pickle this package's functions by value, so workers need no
# installed copy of it (on a cluster, --py-files works as well).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass

from vigil.session import get_spark, ensure_checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "ensure_checkpoint_dir"]
