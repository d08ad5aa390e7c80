"""Operators for preparing training text: search, fingerprints, sharding, filters, packing,
classifiers, personal data, page text and near-duplicate joins.

Nothing else in the library imports this package. Functions that run inside tasks travel by value,
so that executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
