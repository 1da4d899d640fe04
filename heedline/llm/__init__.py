"""Operators for preparing training data: packing, search, deduplication, models, tokenizers.

Nothing else in the library imports this subpackage.  The functions that run inside tasks are
sent with the job, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
