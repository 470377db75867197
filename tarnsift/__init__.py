"""tarnsift: leak-free event-table preparation, split audits and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
