"""Queries over the supplied tables, one per operator, with equivalent SQL where there is one."""

import sys

from pyspark import cloudpickle

# the small predictors of some queries are shipped to executors with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import q_models, q_ranks, q_rows, q_scores, q_sources  # noqa: E402, F401
from .base import ORACLES, QUERIES  # noqa: E402, F401
