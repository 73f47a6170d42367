"""kgloom: multilingual question-answering dataset construction and answer grading on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so a cluster needs no copy of it on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
