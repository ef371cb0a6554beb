"""tessera: retrieval-corpus operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
