"""Spark-native literature screening, ranking and digest engine."""
from pyspark import cloudpickle

from scholarsieve.functions import text

# The few batch helpers travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(text)
