"""Training-data operators on Spark: near-duplicates, chat formatting,
decontamination, packing, quality, token counts, personal data, secrets and
web archives.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
