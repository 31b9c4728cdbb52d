"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run on executors are pickled by value, so executors need numpy, pyarrow and the tokenizer
libraries, but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
