"""Operators for preparing training data: extraction, filtering and deduplication.

Nothing else in the library imports this subpackage. Its functions are pickled by value,
so executors need numpy, pyarrow and the tokenizer libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
