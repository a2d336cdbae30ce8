"""Training-data operators: near duplicates, language, licences, quality, token files, personal data, mixing, decontamination.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that tasks run travel with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
