"""Operators for preparing training data at scale; nothing else in the library imports them.

Tables between steps are written below the scratch folder (``caseloom.session.scratch_dir``)
and read again, so that a lost executor costs the tasks it ran and never a whole lineage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, which so need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
