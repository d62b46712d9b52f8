"""Trajectory analytics on Spark: panel data to kinematics, features, grouped validation and attribution."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
