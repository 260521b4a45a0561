"""Bar analytics on Spark: bars, indicators, events, labels, folds, models and weights as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
