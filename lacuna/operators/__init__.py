"""See the package README for the operator map.

Functions that run on executors are pickled by value: workers need the Python
libraries they use but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
