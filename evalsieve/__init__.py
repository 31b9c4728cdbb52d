"""Spark-native analytics for auditing evaluation benchmarks and curating text corpora.

Functions that run on executors are pickled by value, so executors need numpy, pandas and pyarrow, but no copy of this
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
