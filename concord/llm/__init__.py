"""Operators for training data: scoring, search, licences, duplicates, quality, mixing, tokens, decontamination, personal data.

Functions of this package travel to the workers by value, so a worker needs nothing but Python, numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
