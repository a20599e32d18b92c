"""Evaluation and curation of labelled text as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Tables of predictions
stay long, keyed by ``(run_id, sample_id)``, so one job serves any number of
runs; wide layouts exist only at the edge.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
