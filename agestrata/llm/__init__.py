"""Operators for preparing training text and vectors.

Nothing else in the library imports this package. Its task functions are shipped by
value, so executors need numpy, pyarrow and the libraries each operator names, but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
