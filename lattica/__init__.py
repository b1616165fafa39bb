"""Lattica: a Spark-native engine for literature graphs and the text behind them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to executors carry their code, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
