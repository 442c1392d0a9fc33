"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage.  Functions of its modules travel to
the workers by value, so a worker need not have this folder on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
