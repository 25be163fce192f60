"""Newsloom: PySpark DataFrame operators for watching published articles.

Every public function takes DataFrames and returns DataFrames (or Columns); nothing here
holds articles outside Spark. See ``newsloom.plans.review`` for the composed daily review.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
