"""quire: document-index and corpus-preparation operators as plain Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so a cluster needs no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
