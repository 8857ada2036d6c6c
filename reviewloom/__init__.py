"""Review analytics as Spark jobs: cleaning, search, keywords, sentiment, themes."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
