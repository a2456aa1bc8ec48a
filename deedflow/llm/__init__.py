"""Training-data operators. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import deedflow.llm as _self

# Functions of this subpackage travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(_self)
