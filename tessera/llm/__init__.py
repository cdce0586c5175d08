"""Training-data operators: deduplication, quality, sharding, privacy, URL
rules, chat formatting, decontamination and mixing, each as Spark jobs.

Functions that run inside Arrow tasks are shipped by value, so executors need
numpy and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
