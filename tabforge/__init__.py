"""tabforge: tabular machine-learning workflows expressed as Spark DataFrame jobs.

Layout
------
sources/    CSV scan, delimiter votes, missing tokens, bad lines, sinks
functions/  column expressions (height, numbers in text, dates, splits, grades)
operators/  profile, clean, encode, scale, split, models, neighbours, density,
            hierarchy, metrics, chart data
plans/      the data-dependent prep plan, model runner, chart menu
streaming/  applying a fitted prep plan to a streaming DataFrame
"""

from tabforge.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
