"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it.  Worker code is pickled by value, so executors need
numpy, pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
