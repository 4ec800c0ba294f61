"""Distributed profiling, cleaning, feature and modelling operators for one wide table.

Every operator takes and returns Spark DataFrames.  Operators that need fitted numbers
(quantiles, modes, fences) run one bounded aggregation first and then build a lazy plan
from the resulting literals, the way Spark ML estimators do.
"""

__version__ = "0.1.0"
