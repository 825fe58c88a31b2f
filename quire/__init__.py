"""quire: a Spark-native engine for corpora of marked-up documents.

Functions of this package that run on executors are pickled by value, so a
cluster needs no copy of the package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
