"""Report analytics on Spark: declarative operators over report text and records.

Functions used inside Arrow UDFs are shipped to executors by value, so that a
cluster needs nothing but PySpark, pandas and numpy installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
