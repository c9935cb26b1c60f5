"""keystrata: a keyed-data engine expressed as Spark DataFrames.

The package is pickled by value into Python workers, so executors need no
installed copy of it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
