"""Training-data operators: extraction, packing, fingerprints, mixing, quality, licences,
language-model scores, near duplicates, chat formatting and nearest neighbours.

Each module holds one operator with a general interface and the thin query
that applies it to its whole table; ``queries`` registers the queries.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry these modules' functions with them, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
