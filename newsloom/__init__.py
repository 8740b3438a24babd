"""newsloom: news and social-media text analytics written as Spark jobs.

Every operator takes DataFrames (plus parameters) and returns a DataFrame.
Nothing runs an action while a plan is being built, except MLlib fits and the
explicit ``checkpoint`` used to cut the lineage of iterative jobs.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
