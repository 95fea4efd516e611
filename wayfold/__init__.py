"""Web-capture and session-log analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .session import local_session, prepare

# Executors need not have the package installed: the few Python functions that
# run in tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["local_session", "prepare"]
