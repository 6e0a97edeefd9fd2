"""PySpark-native detection and masking of sensitive values, and operators for building training corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
