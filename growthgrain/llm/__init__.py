"""Operators that prepare text for training language models.

Functions that run inside tasks are sent to the workers by value, so executors need
numpy, pyarrow and the tokenizer libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
