"""Operators of a training-data pipeline, each a set of Spark jobs over documents,
pages or embeddings. Nothing outside this subpackage (and corpus_pipeline.py) imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
