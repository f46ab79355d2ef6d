"""Structural similarity search and corpus preparation on Apache Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors take their code along, so a cluster needs nothing installed but the public libraries.
register_pickle_by_value(sys.modules[__name__])
