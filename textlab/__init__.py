"""textlab: labelled-text corpora, retrieval and detector evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
