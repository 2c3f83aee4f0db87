"""Change analytics over tables of web pages, feeds and documents, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so that they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
