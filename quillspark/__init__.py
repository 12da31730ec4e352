"""quillspark: evidence retrieval analytics as batched Spark plans."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the tasks, so that no copy
# of it has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
