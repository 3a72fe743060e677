"""textprep: preparing, splitting, sampling and evaluating labelled text corpora on Spark.

Every operator is a plain function ``f(df, *, params) -> DataFrame`` built from DataFrame
expressions, joins, windows and aggregates.  Random steps are driven by hashes of a seed and a
row key (see :mod:`textprep.functions.hashing`), so results do not depend on partitioning.
"""

__version__ = "0.1.0"
