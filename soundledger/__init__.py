"""Acoustic-event and telemetry analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the package's small helpers with each job, so that it need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
