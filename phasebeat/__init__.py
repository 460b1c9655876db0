"""Workload-phase analytics for cluster telemetry, as DataFrame-to-DataFrame functions."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from phasebeat.config import Settings

# The few functions that run in tasks travel with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
