"""Schema-contract analytics over message tables and streams, on Spark."""

import sys

from pyspark import cloudpickle

from .session import configure, local_session, materialize, release
from .wire import Wire

# Text kernels travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Wire", "configure", "local_session", "materialize", "release"]
