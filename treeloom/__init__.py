"""treeloom: structural analytics over text and source corpora, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
