"""Operators of a training-data pipeline: packing, deduplication, language and
quality models, mixing, personal data, secrets, line rules and web archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
