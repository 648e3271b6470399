"""trailmill: detection, tracking, evaluation and corpus analytics on PySpark.

Functions that run on executors are pickled by value, so that a job needs no
copy of this package on the workers' Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
