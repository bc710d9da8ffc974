"""Operators of a training-data pipeline: quality, tokens, archives, duplicates, packing, shards.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame plus column names and literal parameters, projects what it needs
(so other columns, whatever their names, never clash) and returns one row per
input row unless its docstring says otherwise.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions sent to them carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
