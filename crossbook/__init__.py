"""crossbook: limit-order matching and trade analytics on Spark.

Functions shipped to executors (the fold, the scans, the stateful
processors) are pickled by value, so executors need no install of this
package; on a cluster it can also be shipped as a zip with ``--py-files``.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
