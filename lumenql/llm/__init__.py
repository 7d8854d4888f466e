"""Training-data operators at corpus scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: executors need the
# libraries, but not this package, on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
