"""Training-data operators.  Nothing else in the library imports this subpackage.

Functions that run on executors are pickled by value, so a cluster needs the
Python libraries they use but not this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
