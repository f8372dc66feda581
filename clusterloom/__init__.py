"""Analytics jobs over Spark DataFrames.

Clustering, diverse-subset selection, variance tests, bit-fingerprint
similarity, a traffic report and process trees.  Every job takes and returns
DataFrames; only centroids, pivots and counters ever reach the driver.
"""

import sys

from pyspark import cloudpickle

# The Arrow functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
