"""Vector profiles of recordings, and their analytics, on PySpark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers with their tasks, wherever it was imported from
cloudpickle.register_pickle_by_value(sys.modules[__name__])
