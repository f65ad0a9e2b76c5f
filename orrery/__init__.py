"""Citation-map analytics on Spark: DataFrame operators for paper metadata, citation graphs, map layout and tiles."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
