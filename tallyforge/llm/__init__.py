"""Training-data operators: dedup, PII, packing, scoring, search, scans, rules.

Nothing outside this package imports it. Functions that run in Python workers
are pickled by value, so a cluster needs no copy of the package on its workers.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
