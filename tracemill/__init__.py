"""tracemill: build, test and lint log analytics as lazy Spark DataFrames."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with their tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
