"""Documentation-coverage analytics over a corpus of projects, on Spark.

The two entry points are :func:`doclumen.plans.assess.assess` (how much of what
the code offers is explained by its documentation?) and
:func:`doclumen.plans.explain.explain` (which documents and sections answer a
batch of topics or questions?).  Both take DataFrames and return DataFrames.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
