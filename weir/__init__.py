"""weir: DNS and service traffic features, profiles and anomaly scores as Spark jobs.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors with the tasks, which then need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
