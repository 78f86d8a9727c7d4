"""Operators of a training-data pipeline over documents, embeddings and conversations.

Nothing else in the library imports this package; the package imports only
``loghound.session``.  Its functions travel to Python workers by value, so the
executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
