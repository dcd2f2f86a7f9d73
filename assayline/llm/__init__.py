"""Operators for preparing training text, and their queries. Nothing outside this folder imports it."""

from pyspark import cloudpickle

import assayline.llm as _this

# Functions sent to executors travel by value, so a worker need not have this folder on its path.
cloudpickle.register_pickle_by_value(_this)
