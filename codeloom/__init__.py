"""codeloom: DataFrame operators for code corpora, retrieval and message streams."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so that executors need
# neither the package nor the driver's import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
